"""The knowledge graph as tables: occurrences of triples are grouped into facts, relations, sources and concepts.

occurrences: subject, predicate, object, url, domain, confidence, seq (order of arrival).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.small import checkpoints
from .containment import contained

QUORUM = 3


def with_keys(occ: DataFrame) -> DataFrame:
    s, p, o = F.col("subject"), F.col("predicate"), F.col("object")
    return occ.withColumn("fact_key", T.fact_key(s, p, o)).withColumn("fact_hash", T.fact_hash(s, p, o))


def facts(occ: DataFrame, quorum: int = QUORUM) -> DataFrame:
    """One row a fact: spelling of its first occurrence, occurrences, confirming domains and urls; verified from `quorum` domains on."""
    first = F.min_by(F.struct("subject", "predicate", "object"), "seq")
    out = with_keys(occ).groupBy("fact_key").agg(first.alias("f"), F.count("*").alias("occurrences"), F.count_distinct("domain").alias("domains"), F.count_distinct("url").alias("urls"))
    # all spellings of a key have one hash, so it is worked out once a fact
    digest = T.fact_hash(F.col("f.subject"), F.col("f.predicate"), F.col("f.object")).alias("fact_hash")
    return out.select("fact_key", digest, "f.*", "occurrences", "domains", "urls", (F.col("domains") >= quorum).alias("verified"))


def recount(facts_: DataFrame, occ: DataFrame, changed: DataFrame, quorum: int = QUORUM) -> DataFrame:
    """facts_ with those that `changed` occurrences touch counted anew over all of occ, the others as they are."""
    keys = with_keys(changed).select("fact_key").distinct()
    new = facts(with_keys(occ).join(keys, "fact_key", "left_semi").drop("fact_key", "fact_hash"), quorum)
    return facts_.join(keys, "fact_key", "left_anti").unionByName(new)


def relations(occ: DataFrame) -> DataFrame:
    """One row an edge: confidence and url of the last occurrence, number of occurrences."""
    last = F.max_by(F.struct("confidence", "url"), "seq")
    return occ.groupBy("subject", "predicate", "object").agg(last.alias("l"), F.count("*").alias("occurrences")).select("subject", "predicate", "object", "l.*", "occurrences")


def sources(occ: DataFrame) -> DataFrame:
    """One row a url: domain of its last occurrence, first and last arrival."""
    return occ.groupBy("url").agg(F.max_by("domain", "seq").alias("domain"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def confirmations(occ: DataFrame) -> DataFrame:
    return with_keys(occ).select("url", "fact_key").distinct()


def mined_from(occ: DataFrame) -> DataFrame:
    return occ.select(F.explode(F.array("subject", "object")).alias("concept"), "url").distinct()


def concepts(occ: DataFrame) -> DataFrame:
    """Names at either end, with the first arrival."""
    ends = occ.select("seq", F.explode(F.array("subject", "object")).alias("name"))
    return ends.groupBy("name").agg(F.min("seq").alias("first_seq"))


def counts(occ: DataFrame, facts_: DataFrame) -> DataFrame:
    """One row: concepts, sources, relations, facts, verified facts, confirmations."""
    f = facts_.agg(F.count("*").alias("facts"), F.count_if("verified").alias("verified"), F.sum("urls").alias("confirmations"))
    o = occ.agg(F.count_distinct("url").alias("sources"), F.count_distinct("subject", "predicate", "object").alias("relations"))
    c = concepts(occ).agg(F.count("*").alias("concepts"))
    return c.join(o).join(f)


def verified_domain_counts(occ: DataFrame, facts_: DataFrame) -> DataFrame:
    """Verified facts that each domain confirms; null domains are left out."""
    pairs = with_keys(occ).filter("domain is not null").select("fact_key", "domain").distinct()
    return pairs.join(facts_.filter("verified").select("fact_key"), "fact_key").groupBy("domain").agg(F.count("*").alias("facts"))


def accounting(facts_: DataFrame) -> DataFrame:
    """One row of counts and a status, the first that holds of zero_facts, query_error, duplicate_fact_hashes, missing_fact_hashes, ok.

    facts_: fact_hash (null or blank: missing). A fact without one counts as a key of its own.
    """
    h = F.when(F.trim("fact_hash") != "", F.col("fact_hash"))
    groups = facts_.select(h.alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    has = F.col("h").isNotNull()
    row = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("persisted_facts"),
        F.count_if(has).alias("distinct_non_null"),
        F.coalesce(F.sum(F.when(~has, F.col("n"))), F.lit(0)).alias("missing"),
        F.count_if(has & (F.col("n") > 1)).alias("duplicate_groups"),
    )
    row = row.withColumn("distinct_keys", F.col("distinct_non_null") + F.col("missing"))
    return row.withColumn("status", status("persisted_facts", "distinct_keys", "duplicate_groups", "missing")).withColumn("gap", F.when(F.col("status") != "query_error", F.col("distinct_keys") - F.col("persisted_facts")))


def status(persisted: str, distinct: str, duplicates: str, missing: str):
    return (
        F.when((F.col(persisted) == 0) & (F.col(distinct) == 0), "zero_facts")
        .when(F.col(distinct) > F.col(persisted), "query_error")
        .when(F.col(duplicates) > 0, "duplicate_fact_hashes")
        .when(F.col(missing) > 0, "missing_fact_hashes")
        .otherwise("ok")
    )


def degrees(occ: DataFrame, top: int = 25) -> DataFrame:
    """The concepts with most outgoing edges; those without any count 0."""
    out = relations(occ).groupBy(F.col("subject").alias("name")).agg(F.count("*").alias("n"))
    return concepts(occ).join(out, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("out_degree")).orderBy(F.desc("out_degree"), "name").limit(top)


def contradictions(occ: DataFrame, positive: str, negative: str) -> DataFrame:
    """Ordered pairs of concepts that one relation affirms and another denies."""
    both = occ.filter(F.col("predicate").isin(positive, negative)).groupBy("subject", "object").agg(F.array_sort(F.collect_set("predicate")).alias("predicates"), F.count("*").alias("occurrences"))
    return both.filter(F.size("predicates") == 2)


def resolve_contradictions(pairs: DataFrame, occ: DataFrame, positive: str, negative: str, top: int = 5) -> DataFrame:
    """Of the first `top` contradictions, the side of the source of highest confidence (then the earlier)."""
    some = pairs.orderBy("subject", "object").limit(top).select("subject", "object")
    sides = occ.filter(F.col("predicate").isin(positive, negative)).join(F.broadcast(some), ["subject", "object"])
    best = F.min_by(F.struct("predicate", "url", "confidence"), F.struct(-F.col("confidence"), F.col("seq")))
    return sides.groupBy("subject", "object").agg(best.alias("b")).select("subject", "object", "b.*")


def verified_export(occ: DataFrame, facts_: DataFrame) -> DataFrame:
    """Verified facts with sorted domains and urls, most confirmed first."""
    by = with_keys(occ).groupBy("fact_key").agg(F.array_sort(F.collect_set("domain")).alias("source_domains"), F.array_sort(F.collect_set("url")).alias("source_urls"))
    out = facts_.filter("verified").join(by, "fact_key", "left")
    return out.select("subject", "predicate", "object", "fact_hash", F.col("urls").alias("confirmations"), "source_domains", "source_urls").orderBy(F.desc("confirmations"), "subject", "predicate", "object")


def edges_verified(occ: DataFrame, facts_: DataFrame) -> DataFrame:
    """Relations with whether their fact is verified; unknown facts aren't."""
    rel = relations(occ).withColumn("fact_key", T.fact_key(F.col("subject"), F.col("predicate"), F.col("object")))
    return rel.join(facts_.select("fact_key", "verified"), "fact_key", "left").select("subject", "predicate", "object", F.coalesce("verified", F.lit(False)).alias("verified"))


def topology(edges: DataFrame, top: int = 100) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of the first `top` edges in order: nodes with a verified link are of group 2 and size 22, others 1 and 14."""
    links = edges.orderBy("subject", "predicate", "object").limit(top).select(F.col("subject").alias("source"), F.col("object").alias("target"), F.col("predicate").alias("label"), "verified")
    ends = links.select(F.explode(F.array("source", "target")).alias("id"), "verified")
    nodes = ends.groupBy("id").agg(F.bool_or("verified").alias("verified"))
    v = F.col("verified")
    return nodes.select("id", F.when(v, 2).otherwise(1).alias("group"), F.when(v, 22).otherwise(14).alias("val"), "verified"), links


def adjacency(links: DataFrame) -> DataFrame:
    """Undirected neighbours of each node, without self-loops."""
    a, b = F.col("source"), F.col("target")
    both = links.select(a.alias("name"), b.alias("neighbour")).union(links.select(b, a)).filter("name <> neighbour").distinct()
    return both.groupBy("name").agg(F.array_sort(F.collect_set("neighbour")).alias("neighbours"))


def paths(edges: DataFrame, seed: str, top: int | None = None) -> DataFrame:
    """Undirected paths of one or two different edges from `seed`: (origin, relations, target), distinct and in order.

    edges: id, subject, predicate, object.
    """
    both = edges.select("id", F.col("subject").alias("a"), "predicate", F.col("object").alias("b")).union(edges.select("id", F.col("object"), "predicate", F.col("subject")))
    one = both.filter(F.col("a") == seed).select("id", F.col("predicate").alias("p1"), "b")
    hop = both.select(F.col("id").alias("id2"), F.col("a").alias("b"), F.col("predicate").alias("p2"), F.col("b").alias("c"))
    two = one.join(hop, "b").filter("id <> id2")
    found = one.select(F.array("p1").alias("relations"), F.col("b").alias("target")).union(two.select(F.array("p1", "p2"), "c"))
    found = found.distinct().select(F.lit(seed).alias("origin"), "relations", "target").orderBy(F.size("relations"), "relations", "target")
    return found if top is None else found.limit(top)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of undirected edges (a, b): the least node reachable. Minimum labels with pointer jumping, lineage cut by checkpoint."""
    checkpoints(edges.sparkSession)
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("root")).checkpoint()
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(seen, "node").select("node", "root", F.least("root", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("root").alias("far"))
        after = step.join(jump, "new", "left").select("node", "root", F.least("new", F.coalesce("far", "new")).alias("new")).checkpoint()
        moved = after.filter("new <> root").limit(1).count()
        labels = after.select("node", F.col("new").alias("root"))
        if not moved:
            return labels


def search_context(edges: DataFrame, words: DataFrame, top: int = 8) -> DataFrame:
    """Edges whose subject or object contains a keyword (words: keyword), distinct, in order."""
    keys = words.select(F.lower("keyword").alias("__word")).distinct()
    names = edges.select(F.explode(F.array("subject", "object")).alias("name")).distinct().withColumn("__low", F.lower("name"))
    hit = contained(names, ["name"], "__low", keys, "__word").select("name").distinct()
    ends = edges.join(hit.select(F.col("name").alias("subject")), "subject", "left_semi").unionByName(edges.join(hit.select(F.col("name").alias("object")), "object", "left_semi"))
    return ends.distinct().orderBy("subject", "predicate", "object").limit(top)


def last_write(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of one key the last, as an upsert leaves it."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("__r", last).filter("__r = 1").drop("__r")
