"""What the findings of round 3 were about, on small rows: ties, plans that pass over their rows once, and results that stay."""

import contextlib
import io
import random
import re

from pyspark.sql import functions as F

from quorumlake.operators import accounting as A
from quorumlake.operators import refine as R
from quorumlake.operators import tables as B
from quorumlake.operators import terms as X
from quorumlake.operators import vectors as V
from quorumlake.plans.registry import QUERIES
from quorumlake.sources import readers as IO
from quorumlake.streaming import store as K


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as said:
        df.explain()
    return said.getvalue()


def test_records_parse_pages_once(spark):
    pages = spark.createDataFrame([(i, f"<table><tr><th>Clube<th>Anos<tr><td>c{i}<td>190{i % 10}</table>") for i in range(200)], "page_id bigint, html string")
    cells = B.grids(pages.coalesce(1))
    rows = B.records(cells)
    assert plan(rows).count("MapInArrow") == 1
    assert {(r.page_id, r.row, *[tuple(f) for f in r.fields]) for r in rows.collect()} == {(i, 1, ("Clube", f"c{i}"), ("Anos", f"190{i % 10}")) for i in range(200)}


def test_last_lines_of_a_log_by_ties(spark, tmp_path):
    lines = spark.range(9).select(F.lit(5.0).alias("timestamp"), F.concat(F.lit("k"), "id").alias("kind"), F.struct(F.concat(F.lit("e"), 10 - F.col("id")).alias("source_url")).alias("content"))
    lines.repartition(3).write.json(str(tmp_path / "log"))
    event = F.substring("content.source_url", 2, 20).cast("bigint")
    assert [r.kind for r in IO.episode_log(spark, str(tmp_path / "log"), 3, (event,)).collect()] == ["k8", "k7", "k6"]


def test_episode_log_query_reads_the_last_million_lines(spark):
    assert "limit=1000000," in plan(QUERIES["s13_episode_log"](spark, "/root/testdata/sf0.001"))


def test_first_targets_sort_nothing_that_is_found(spark):
    facts = spark.createDataFrame([(1, "g", "a red ring"), (2, "g", "blue"), (3, "h", "red"), (4, "g", "none"), (5, None, "red")], "id bigint, group string, haystack string")
    rows = [("g", 2, "red", "late"), ("g", 1, "ring", "early"), ("g", 3, "blue", "b"), ("g", 2, "blue", "late"), ("h", 7, "red", "h7"), ("h", 9, "red", "h9"), (None, 1, "red", "x")]
    aliases = spark.createDataFrame(rows, "group string, pos int, alias string, target string")
    got = X.first_targets(facts, aliases)
    assert sorted(map(tuple, got.collect())) == [(1, "g", "early"), (2, "g", "late"), (3, "h", "h7")]
    assert "min_by" not in plan(got)


def test_containing_looks_for_words_in_different_words_once(spark):
    docs = [(1, "Xalphabet beta-gamma"), (2, "alp habet, BETA"), (2, "gammas"), (3, None), (4, "ñalphañ zzbetazz"), (None, "alpha")]
    facts = [(7, "alpha beta gamma"), (8, "alpha alpha beta beta gamma"), (9, "a b"), (9, None)]
    d, f = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(facts, "item_id bigint, text string")
    got = R.containing(d, f)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 7), (1, 8), (2, 7), (2, 8), (4, 7), (4, 8)], key=str)
    assert "NestedLoop" not in plan(got)


def test_top_k_in_bounded_blocks(spark):
    r = random.Random(3)
    rows = [(i, [float(r.randrange(3)) for _ in range(3)]) for i in range(700)]
    asked, there = spark.createDataFrame(rows[::10], "query_id bigint, q array<double>"), spark.createDataFrame(rows, "vec_id bigint, v array<double>")
    want = [tuple(x) for x in V.top_k(asked, there, 4, block=10_000).orderBy("query_id", "rank").collect()]
    assert [tuple(x) for x in V.top_k(asked, there, 4, block=20, most=3).orderBy("query_id", "rank").collect()] == want and len(want) == 280


def test_arrivals_sort_firsts_alone(spark):
    r = random.Random(5)
    rows = [(f"f{r.randrange(3)}", r.choice(["u1", "u2", "u3", None]), r.choice(["d1", "d2", None]), i) for i in range(300)]
    keys, urls, domains, want = set(), set(), set(), {}
    for f, u, d, i in rows:
        want[i] = "new" if f not in keys else "same_url" if (f, u) in urls else "same_domain" if (f, d) in domains else "cross_domain"
        keys.add(f)
        urls.add((f, u))
        domains.add((f, d))
    got = A.arrivals(spark.createDataFrame(rows, "fact_key string, url string, domain string, seq int"))
    assert {x.seq: x["class"] for x in got.collect()} == want and got.count() == 300
    assert not re.search(r"hashpartitioning\(fact_key#\d+, \d", plan(got))


def test_one_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    columns = "subject string, predicate string, object string, url string, domain string, confidence double, seq int"
    rows = [("s", "p", "o", f"u{i % 3000}", f"d{i % 7}", 0.5, -i) for i in range(4000)]
    sizes = [f"spark.sql.adaptive.{x}" for x in ("advisoryPartitionSizeInBytes", "coalescePartitions.minPartitionSize")]
    for size in sizes:
        spark.conf.set(size, "2k")
    try:
        for n in range(2):
            K.apply(spark.createDataFrame(rows[n::2], columns), n, str(tmp_path / "store"), K.FACTS)
    finally:
        for size in sizes:
            spark.conf.unset(size)
    at = K.layout(spark, str(tmp_path / "store"))
    (base,) = at.names
    assert max(len(list(b.glob("*.parquet"))) for b in (tmp_path / "store" / base / "state").glob("bucket=*")) > 1
    assert [r[0] for r in K.current(spark, str(tmp_path / "store"), K.FACTS).select(F.concat_ws("|", "subject", "occurrences", "domains", "urls")).collect()] == ["s|4000|7|3000"]


def test_facts_of_unmerged_rows_are_not_expanded(spark):
    rows = spark.createDataFrame([("k", "u1", "d", (2, "S", "p", "o"), 1), ("k", "u1", "d", (1, "s", "p", "o"), 4), ("k", None, None, (3, "x", "p", "o"), 1), ("n", None, None, (3, None, None, None), 1)],
                                 "fact_key string, url string, domain string, first struct<seq int, subject string, predicate string, object string>, occurrences bigint")
    got = K.FACTS.result(rows)
    assert sorted((r.fact_key, r.subject, r.occurrences, r.domains, r.urls) for r in got.collect()) == [("k", "s", 6, 1, 1), ("n", None, 1, 0, 0)]
    assert not any("min(first" in x for x in plan(got).splitlines() if "Expand" in x) and K.FACTS.unmerged
