"""From raw documents to a training mix: five stages, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs has the columns of documents, and all stages but the last
return these. The last adds what the mix takes of each document. Null, empty and repeated rows: as in each operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm import language_mix, line_templates, near_copies, simhash, source_mix, spaced_seeds
from quorumlake.llm.shared import forget, settled


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without a language that makes up half of them, go."""
    return language_mix.keep_identified(docs)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go from all but the first; n_chars follows the text."""
    kept = line_templates.drop_recurring(docs, counts=False)
    chars = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return kept.select(*[chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies by fingerprint (op9: SimHash, 2 or fewer bits) the document of least doc_id stays; of these
    then one of each group of five-word shingles alike by 0.8 or more, which 2 bits of a fingerprint don't reach."""
    return near_copies.one_of_each(settled(lambda: simhash.one_of_each(docs)))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return spaced_seeds.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with size, source_size, target and taken (words, repeats counted), which replace columns of these names."""
    took = source_mix.taken(*source_mix.mix(docs)).filter("taken > 0")
    key, new = ["doc_id", "source", "size"], ["source_size", "target", "taken"]
    took = took.groupBy(*[F.col(c).alias(f"__{c}") for c in key]).agg(*[F.max(c).alias(f"__{c}") for c in new])
    sized = docs.withColumn("__words", F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")))
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size"))
    added = ["size", *new]
    return sized.join(took, same).select(*[F.col(c) for c in docs.columns if c not in added], *[F.col(f"__{c}").alias(c) for c in added])


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", drop_recurring_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("source_mix", mix_sources),
]
#: SQL can express neither the learned language model nor the components; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. What one writes on the way is deleted once its result is written, and that once the next one's is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if i:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
