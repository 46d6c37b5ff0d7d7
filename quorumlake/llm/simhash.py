"""Near-duplicate documents by SimHash, with pigeonhole blocks for the search and an exact path for crowded blocks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, cut, row_key, rows_of, settled

#: A block with more fingerprints than this is searched by one-bit neighbours instead of pairs; both are exact.
CROWDED = 48


def _fingerprint(text: bytes | None, words: int, seed: int = 42) -> int:
    """Of one text in UTF-8: the majority bit over the XXH64 of its shingles; 0 without words."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < words else [b" ".join(x) for x in zip(*(w[i:] for i in range(words)), strict=False)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(grams), 1 << 16):
        h = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in grams[i : i + (1 << 16)]), np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(grams)).tobytes(), "big", signed=True)


def fingerprint(text: Column, words: int = 3) -> Column:
    """bigint, of whole texts. Only A-Z are lower-cased; words lie between ASCII white space; null and blank texts: 0."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([_fingerprint(x.as_py(), words) for x in texts], pa.int64())

    return run(text.cast("binary"))


def _blocks() -> list[int]:
    """Masks of the choices of 3 of 5 blocks: at most 2 of 5 differ, so some 3 agree whole."""
    edges = [round(64 * i / 5) for i in range(6)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in map(sum, combinations(blocks, 3))]


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of distinct fingerprints `fp` at 2 or fewer differing bits.

    Pigeonhole: the fingerprint is cut into 5 blocks; a pair that close agrees on 3 of them, so rows are joined on each
    choice of 3 blocks and the Hamming distance of each pair is verified. In a block shared by more than CROWDED
    fingerprints pairs would grow as the square. There every fingerprint instead sends itself to its 65 values within
    one bit, and those that meet at a value are linked to the least of them: two fingerprints are 2 or fewer bits apart
    exactly if such a midpoint exists, so no link is lost and none is added, at 65 rows per fingerprint.
    """
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _blocks()])).alias("mask", "block"))
    shared = cut(keyed.groupBy("mask", "block").agg(F.count("*").alias("n")).filter("n > 1"))
    rows = cut(keyed.join(shared, ["mask", "block"]))
    some, many = rows.filter(F.col("n") <= CROWDED), rows.filter(F.col("n") > CROWDED).select("fp").distinct()
    left, right = some.select("mask", "block", F.col("fp").alias("u")), some.select("mask", "block", F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2
    pairs = left.join(right, ["mask", "block"]).filter(F.col("u") > F.col("v")).filter(near).select("u", "v")
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64)]
    met = many.select("fp", F.explode(F.array(*flips)).alias("mid"))
    star = met.groupBy("mid").agg(F.min("fp").alias("v"), F.max("fp").alias("top")).filter("v < top")
    return pairs.union(met.join(star, "mid").filter("fp > v").select("fp", "v")).distinct()


def _named(by_doc: DataFrame) -> DataFrame:
    """by_doc (with doc_id and fp) with root and component_id."""
    fps = cut(by_doc.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(fps))
    named = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    groups = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return by_doc.join(cut(named.join(groups, "root").select("fp", "root", "component_id")), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per input row: doc_id, fp bigint, root bigint (least fingerprint of its component), component_id (least doc_id).

    Null and blank texts have fingerprint 0 and are linked like any other. Repeated rows come back repeated. A null doc_id
    stands behind every other; a component of null ids alone has a null component_id. An empty table gives no rows.
    Other columns of the input are not read, so their names are free.
    """
    by_doc = cut(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), fingerprint(F.col(text_col), words).alias("fp")))
    return _named(by_doc).select("doc_id", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, words: int = 3) -> DataFrame:
    """The rows of docs that stand for their group, one for each: that with the least doc_id. Columns stay as they are.

    Of rows repeated under one doc_id in one group one stays. Nulls, blanks and empty tables: as in near_duplicates.
    Each text is fingerprinted once; the rows that stay are then met by their hash, so texts aren't shuffled.
    """

    def chosen() -> DataFrame:
        by_row = cut(docs.select(row_key(), F.col("doc_id").cast("bigint").alias("doc_id"), fingerprint(F.col("text"), words).alias("fp")))
        stay = _named(by_row).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "row").agg(F.count("*").alias("times"))
        return stay.groupBy("root").agg(F.min(F.struct("row", "times")).alias("x")).select("x.*")

    return rows_of(docs, settled(chosen))
