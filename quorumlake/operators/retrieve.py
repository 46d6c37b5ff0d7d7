"""Hybrid retrieval and extractive answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def relation_search(edges: DataFrame, message: str, top: int = 8) -> DataFrame:
    """Edges by how many words of the message their names hold: most first."""
    words = F.array(*[F.lit(w) for w in {w for w in message.lower().split() if len(w) > 2}])
    text = F.lower(F.concat_ws(" ", "subject", "predicate", "object"))
    hits = F.size(F.filter(words, lambda w: F.contains(text, w)))
    return edges.withColumn("hits", hits).filter("hits > 0").orderBy(F.desc("hits"), "subject", "predicate", "object").limit(top)


def hybrid_context(facts: DataFrame, vectors: DataFrame, lines: DataFrame, cut: int = 400) -> DataFrame:
    """(kind, text) of the union of fact lines, vector hits (cut) and graph paths; a text comes once, from the first kind."""
    a = facts.select(F.lit(0).alias("k"), F.lit("fact").alias("kind"), F.concat_ws(" ", "subject", "predicate", "object").alias("text"))
    b = vectors.select(F.lit(1), F.lit("vector"), F.left("text", F.lit(cut)))
    c = lines.select(F.lit(2), F.lit("path"), F.concat_ws(" -> ", "origin", F.array_join("relations", " -> "), "target"))
    return a.union(b).union(c).groupBy("text").agg(F.min_by("kind", "k").alias("kind"))


def answer(context: DataFrame, most: int = 5) -> DataFrame:
    """One row per question: the first facts as bullets or the fixed fallback, sorted sources, whether any is verified.

    context: question, text, source, verified, pos.
    """
    lines = F.slice(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("pos", "text")))), 1, most)
    out = context.groupBy("question").agg(lines.alias("l"), F.array_sort(F.collect_set("source")).alias("sources"), F.coalesce(F.bool_or("verified"), F.lit(False)).alias("verified"))
    said = F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x["text"])), "\n")
    return out.select("question", F.when(F.size("l") > 0, said).otherwise("No facts are known about this.").alias("reply"), F.array_join("sources", ",").alias("sources"), "verified")


def knowledge_gap(counts: DataFrame) -> DataFrame:
    """What to do next by known facts: search, expand below 3, else reflect."""
    n = F.col("facts")
    return counts.withColumn("decision", F.when(n == 0, "search").when(n < 3, "expand").otherwise("reflect"))


def nearest_or_search(hits: DataFrame, least: float = 0.75) -> DataFrame:
    """The best hit of each query if it is near enough, else where to look outside."""
    best = hits.groupBy("query_id").agg(F.max_by(F.struct("vec_id", "score"), F.struct("score", -F.col("vec_id"))).alias("b"))
    return best.select("query_id", F.when(F.col("b.score") >= least, F.col("b.vec_id")).alias("vec_id"), F.when(F.col("b.score") >= least, "memory").otherwise("search").alias("origin"))


def fetch_and_verify(pages: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(approved, quarantined) of pages (url, text, score): a low score is quarantined and still approved, as a tee, not a filter."""
    return pages, pages.filter(F.col("score") < least).withColumn("reason", F.lit("low_score"))


def sft_records(facts: DataFrame) -> DataFrame:
    """Verified facts as instruction, input and output."""
    n = F.col("confirmations")
    tail = F.concat(F.lit(" (confirmed by "), n.cast("string"), F.when(n == 1, " source)").otherwise(" sources)"))
    return facts.select(
        F.concat(F.lit("What is known of "), "subject", F.lit("?")).alias("instruction"), F.coalesce("source_domains", F.lit("")).alias("input"),
        F.concat_ws(" ", "subject", F.lower(F.translate("predicate", "_", " ")), "object").alias("fact"), tail.alias("tail"),
    ).select("instruction", "input", F.concat("fact", "tail").alias("output"))


def keywords_of(turns: DataFrame) -> DataFrame:
    words = T.keywords(F.col("text"))
    return turns.select("conv_id", "turn", words.alias("words")).withColumn("longest", T.longest_keyword(F.col("words")))
