"""Hybrid context for many questions at once: facts by keyword, vector hits, and paths of one or two edges around the main term.

What is bounded for a question is bounded before it is joined to it: terms are looked up once for all questions that use them, each term keeps
the first facts and paths in order, and each node its first neighbours, so neither a common term nor a hub brings all its edges in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .containment import contained


def _first(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first `most` rows of each group; few enough for tasks to cut their own down before they are shuffled."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__r") <= most).drop("__r")


def terms(questions: DataFrame) -> DataFrame:
    """(question_id, term, main) of questions (question_id, text): up to six keywords each, the longest as the main one. Questions without words have none."""
    words = T.keywords(F.col("text"))
    found = questions.select("question_id", words.alias("w")).withColumn("m", T.longest_keyword(F.col("w")))
    return found.select("question_id", F.explode("w").alias("term"), "m").select("question_id", "term", (F.col("term") == F.col("m")).alias("main")).distinct()


def named(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(term, name): names of edges that contain a term (asked: term)."""
    names = edges.select(F.explode(F.array("subject", "object")).alias("name")).distinct().withColumn("__low", F.lower("name"))
    return contained(names, ["name"], "__low", asked.select("term").distinct(), "term").select("term", "name")


def term_facts(edges: DataFrame, hits: DataFrame, top: int = 8) -> DataFrame:
    """(term, subject, predicate, object): the first `top` edges in order with a name that holds the term (hits: term, name)."""
    order = [F.col(c) for c in ("subject", "predicate", "object")]
    found = None
    for side in ("subject", "object"):
        ends = edges.select("subject", "predicate", "object").distinct()
        # of each name no more than the first `top` can count
        ends = _first(ends, [side], order, top)
        part = ends.join(hits.select("term", F.col("name").alias(side)), side).select("term", "subject", "predicate", "object")
        found = part if found is None else found.unionByName(part)
    return _first(found.distinct(), ["term"], order, top)


def term_paths(edges: DataFrame, hits: DataFrame, top: int = 15) -> DataFrame:
    """(term, hops, origin, relations, target): the first `top` undirected paths of one or two different edges from names that hold the term.

    edges: id, subject, predicate, object. Shorter paths come first, then by origin, relations and target; equal ones count once.
    """
    both = edges.select("id", F.col("subject").alias("a"), "predicate", F.col("object").alias("b")).unionByName(edges.select("id", F.col("object").alias("a"), "predicate", F.col("subject").alias("b")))
    near = both.groupBy("a", "predicate", "b").agg(F.count_distinct("id").alias("ways"), F.min("id").alias("id"))
    # one more than needed: a step back along the edge that was come by is no path
    near = _first(near, ["a"], [F.col("predicate"), F.col("b")], top + 1)
    order = [F.col(c) for c in ("hops", "origin", "relations", "target")]
    one = near.join(hits.select("term", F.col("name").alias("a")), "a").select("term", F.lit(1).alias("hops"), F.col("a").alias("origin"), F.array("predicate").alias("relations"), F.col("b").alias("target"), "ways", "id")
    one = _first(one, ["term"], order, top)
    # a term with enough paths of one edge needs none of two
    few = one.groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") < top).select("term")
    step = near.select(F.col("a").alias("target"), F.col("predicate").alias("p2"), F.col("b").alias("far"), F.col("ways").alias("ways2"), F.col("id").alias("id2"))
    two = one.join(few, "term").join(step, "target").filter("not (ways = 1 and ways2 = 1 and id = id2)")
    two = two.select("term", F.lit(2).alias("hops"), "origin", F.concat("relations", F.array("p2")).alias("relations"), F.col("far").alias("target")).distinct()
    return _first(one.drop("ways", "id").unionByName(two), ["term"], order, top)


def context(questions: DataFrame, edges: DataFrame, vectors: DataFrame, facts: int = 8, paths: int = 15, chars: int = 400) -> DataFrame:
    """(question_id, kind, text): fact lines, vector hits and path lines of each question; a text comes once, from the first of these kinds.

    questions: question_id, text; edges: id, subject, predicate, object; vectors: question_id, text, as found. Null questions and names that
    hold no term bring nothing; repeated rows count once.
    """
    asked = terms(questions)
    hits = named(edges, asked)
    by_term = asked.join(term_facts(edges, hits, facts), "term").drop("term", "main").distinct()
    lines = _first(by_term, ["question_id"], [F.col(c) for c in ("subject", "predicate", "object")], facts)
    lines = lines.select("question_id", F.lit(0).alias("k"), F.concat_ws(" ", "subject", "predicate", "object").alias("text"))
    found = vectors.select("question_id", F.lit(1).alias("k"), F.left("text", F.lit(chars)).alias("text")).filter("text <> ''")
    around = asked.filter("main").join(term_paths(edges, hits, paths), "term")
    around = around.select("question_id", F.lit(2).alias("k"), F.concat("origin", F.lit(" via ["), F.array_join("relations", " -> "), F.lit("] "), "target").alias("text"))
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("fact", "vector", "path")]), F.min("k") + 1)
    return lines.unionByName(found).unionByName(around).groupBy("question_id", "text").agg(kinds.alias("kind"))
