"""Near copies by exact similarity: of sets of five-word shingles, four fifths of those of either text are shared by both.

An exact set join. Where two sets have a similarity of 0.8 or more, more than four fifths of the larger are in the smaller, so
whatever the order in which shingles are laid, the first fifth and one more of each share a shingle (pigeonhole). Only these
prefixes are joined. Two prefixes tell how much two sets share at most: pairs that can't reach the similarity go by that,
the others are verified on the whole sets; no pair is lost, whatever the edits and the lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST, components, cut, forget, row_key, rows_of, settled

WORDS = 5
#: Shingles laid last in the order: the most frequent ones of one document in SAMPLE. The order changes the work, not the pairs.
COMMON, SAMPLE = 65_536, 16


def _shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of the shingles of one text in UTF-8, in order; of a shorter text, that of all its words."""
    w = (text or b"").lower().split()
    if not w:
        return np.empty(0, np.int64)
    k = min(words, len(w))
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    out = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)]
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    """The numbers of all sets in one buffer, without a copy of each as Python objects."""
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))


def shingles(text: Column) -> Column:
    """array<bigint>, of whole texts. Only A-Z are lower-cased; words lie between ASCII white space; null and blank texts: none."""

    @F.arrow_udf("array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        return _lists([_shingles(x.as_py()) for x in texts])

    return run(text.cast("binary"))


def _signed(text: Column, common: list[int]) -> Column:
    """struct: sk, the hash of the set; n, its size; rare, how many are not common; prefix, the first n / 5 + 1, rare ones first."""
    last = np.sort(np.array(common, np.int64))

    @F.arrow_udf("sk bigint, n int, rare int, prefix array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        sks, sizes, rares, prefixes = [], [], [], []
        for x in texts:
            s = _shingles(x.as_py())
            at = np.minimum(np.searchsorted(last, s), max(len(last) - 1, 0))
            known = last[at] == s if len(last) else np.zeros(len(s), bool)
            sks.append(int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64)))
            sizes.append(len(s))
            rares.append(int((~known).sum()))
            prefixes.append(np.concatenate([s[~known], s[known]])[: len(s) // 5 + 1].copy())
        return pa.StructArray.from_arrays([pa.array(sks, pa.int64()), pa.array(sizes, pa.int32()), pa.array(rares, pa.int32()), _lists(prefixes)], ["sk", "n", "rare", "prefix"])

    return run(text.cast("binary"))


def _side(nodes: DataFrame, name: str) -> DataFrame:
    """(name, {name}_n, {name}_prefix, {name}_edge): edge is where the prefix ends in the order of all shingles."""
    edge = F.struct(F.size("prefix") > F.col("rare"), F.element_at("prefix", -1))
    return nodes.filter("n > 0").select(F.col("sk").alias(name), F.col("n").alias(f"{name}_n"), F.col("prefix").alias(f"{name}_prefix"), edge.alias(f"{name}_edge"))


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of pairs (u, v) of sets those of similarity 0.8 or more.

    What two sets share is in both prefixes or behind the end of that prefix which ends first: those that the prefixes share
    and the rest of that set together bound it.
    """
    both = pairs.join(_side(nodes, "u"), "u").join(_side(nodes, "v"), "v")
    rest = F.when(F.col("u_edge") <= F.col("v_edge"), F.col("u_n") - F.size("u_prefix")).otherwise(F.col("v_n") - F.size("v_prefix"))
    most = F.size(F.array_intersect("u_prefix", "v_prefix")) + rest
    pairs = cut(both.filter(9 * most >= 4 * (F.col("u_n") + F.col("v_n"))).select("u", "v"))
    need = pairs.select(F.col("u").alias("sk")).union(pairs.select("v")).distinct()
    need = cut(need.join(nodes, "sk").select("sk", "row"))
    texts = docs.select(row_key(), "text")
    texts = texts.join(F.broadcast(need) if need.count() <= BROADCAST else need, "row")
    sets = cut(texts.dropDuplicates(["sk"]).select("sk", shingles(F.col("text")).alias("set")))
    both = pairs.join(sets.select(F.col("sk").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("sk").alias("v"), F.col("set").alias("b")), "v")
    found = cut(both.filter(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v"))
    forget(pairs, need, sets)
    return found


def _links(rows: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of similarity 0.8 or more, from rows (h, c, sk, n, rare, pos) of shared prefixes.

    First each set is held against one of its bucket, that with fewest rare shingles, as the original of many copies has.
    Then all pairs of a bucket are that lie in different components so far. Of a pair's first shared shingle both sets
    still have enough shingles behind it; what fails that is not verified.
    """
    lead = rows.groupBy("h").agg(F.min(F.struct("rare", "sk", "n", "pos")).alias("lead"))
    lead = lead.select("h", F.col("lead.sk").alias("v"), F.col("lead.n").alias("v_n"), F.col("lead.pos").alias("v_pos"))

    def enough(n: str, pos: str, m: str, at: str) -> Column:
        return 9 * F.least(F.col(n) - F.col(pos), F.col(m) - F.col(at)) >= 4 * (F.col(n) + F.col(m))

    first = rows.join(lead, "h").filter(F.col("sk") != F.col("v")).filter(enough("n", "pos", "v_n", "v_pos"))
    first = cut(first.select(F.greatest("sk", "v").alias("u"), F.least("sk", "v").alias("v")).distinct())
    found = _verified(first, docs, nodes)
    roots = components(found)
    rest = rows.filter("c > 2").join(roots, F.col("sk") == F.col("node"), "left").select("h", "sk", "n", "pos", F.coalesce("root", "sk").alias("root"))
    mixed = rest.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("h")
    left = cut(rest.join(mixed, "h"))
    right = left.select("h", *[F.col(c).alias(f"v_{c}") for c in ("sk", "n", "pos", "root")])
    apart = (F.col("sk") > F.col("v_sk")) & (F.col("root") != F.col("v_root")) & enough("n", "pos", "v_n", "v_pos")
    more = cut(left.join(right, "h").filter(apart).select(F.col("sk").alias("u"), F.col("v_sk").alias("v")).distinct().join(first, ["u", "v"], "left_anti"))
    forget(left, first)
    return found.union(_verified(more, docs, nodes))


def near_copies(docs: DataFrame) -> DataFrame:
    """One row per distinct row (doc_id, text): row (its hash), doc_id, sk (hash of the set), times (how often it comes), root (least sk of its component), component_id (least doc_id).

    Null and blank texts have the same empty set and are one group. A null doc_id stands behind every other. An empty table gives no rows.
    """
    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select(F.explode(shingles(F.col("text"))).alias("h"))
    common = [r.h for r in some.groupBy("h").count().filter("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).collect()]
    by_row = docs.select(row_key(), F.col("doc_id").cast("bigint").alias("doc_id"), _signed(F.col("text"), common).alias("x"))
    by_row = cut(by_row.select("row", "doc_id", "x.*"))
    firsts = by_row.groupBy("sk").agg(F.min("doc_id").alias("first_id"), F.min("row").alias("row"))
    kept = by_row.join(firsts.select("row"), "row").dropDuplicates(["row"])
    nodes = cut(kept.select("sk", "row", "n", "rare", "prefix"))
    members = by_row.select("row", "doc_id", "sk")
    keyed = nodes.select("sk", "n", "rare", F.posexplode("prefix").alias("pos", "h"))
    shared = keyed.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1")
    rows = cut(keyed.join(shared, "h"))
    roots = components(_links(rows, docs, nodes.select("sk", "row", "n", "rare", "prefix")))
    forget(rows)
    first_ids = members.groupBy("sk").agg(F.min("doc_id").alias("first_id"))
    named = first_ids.join(roots, F.col("sk") == roots.node, "left").select("sk", "first_id", F.coalesce("root", "sk").alias("root"))
    groups = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = cut(named.join(groups, "root").select("sk", "root", "component_id"))
    return members.groupBy("row", "doc_id", "sk").agg(F.count("*").alias("times")).join(named, "sk").select("row", "doc_id", "sk", "times", "root", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their group, one for each: that with the least doc_id. Columns stay as they are.

    Of rows repeated under one doc_id in one group one stays. Nulls, blanks and empty tables: as in near_copies.
    """

    def chosen() -> DataFrame:
        stay = near_copies(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        return stay.groupBy("root").agg(F.min(F.struct("row", "times")).alias("x")).select("x.*")

    return rows_of(docs, settled(chosen), BROADCAST)
