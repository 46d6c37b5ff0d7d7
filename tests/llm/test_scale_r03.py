"""What the findings of round 3 on the pipeline were about, on small rows."""

from pyspark.sql import functions as F

from quorumlake.llm import shared, simhash


def test_texts_of_those_that_stay_are_read_once_and_not_fingerprinted_again(spark):
    rows = [(1, "a b c d", "p"), (2, "a b c d", "q"), (2, "A b c d", "r"), (3, "e f g h i j", "s"), (3, "e f g h i j", "t"), (4, "k l m n", "u")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    said = kept._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in said
    got = sorted((r.doc_id, r.text) for r in kept.collect())
    assert got == [(1, "a b c d"), (3, "e f g h i j"), (4, "k l m n")] and sorted(kept.columns) == ["doc_id", "lang", "text"]


def test_more_than_may_be_broadcast(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, "c")], "doc_id bigint, text string")
    stay = docs.distinct().select(shared.row_key(), F.lit(2).alias("times"))
    assert sorted(map(str, shared.rows_of(docs, stay, 0).collect())) == sorted(map(str, docs.distinct().collect()))
