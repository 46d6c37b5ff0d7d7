"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

Inner products become distances on a sphere: vectors get one more component that brings all to the largest norm, queries get a
zero there. Centroids are fitted on a bounded sample and split where their lists would be long; each vector is written to every
list whose centroid is nearly as near as the nearest, so those on a boundary stand in several. Centroids are few enough
for a worker's memory and are searched along a graph of their neighbours; of the lists met, a query reads those whose distance
is within a ratio of the nearest. Lists, and the queries that read them, are cut into blocks of bounded size.

Equal vectors are searched once. A query first reads its nearest lists; the others then return only what scores no less than
the last of the best found there, the rest being out for certain.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import fsum

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut

#: Rows that the centroids are fitted on, at most. Every row is indexed.
FIT = 32_768
#: Vectors of a list, about, and lists at most (centroids and their graph are sent to every worker).
LIST, LISTS = 256, 4_096
#: A vector stands in the lists within this ratio of the nearest distance, at most COPIES; a query reads those within READ.
CLOSE, COPIES, READ = 1.04, 3, 1.27
BLOCK, DEGREE, ENTRIES = 2_048, 24, 16
#: Lists that a query reads first.
FIRST = 8


@dataclass
class Index:
    """What workers need: unit centroids, their neighbours, and the largest norm of a vector."""

    centroids: np.ndarray
    graph: np.ndarray
    norm: float
    kind: str  # of the components as stored: f4 or f8


def _lift(x: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm * norm - (x * x).sum(1), 0))
    return (np.c_[x, rest] / norm).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(x[i : i + 2048] @ c.T, axis=1) for i in range(0, len(x), 2048)]) if len(x) else np.zeros(0, int)


def _centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spread rows; then lists of more than twice the mean are halved and empty ones dropped."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for turn in range(rounds + 3):
        own = _nearest(x, c)
        counts = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = _unit(np.where(counts[:, None] > 0, sums, c))
        if turn >= rounds - 1:
            large = np.flatnonzero(counts > 2 * len(x) / k)
            halves = [_unit(c[j : j + 1] + 0.5 * (x[own == j][-1] - c[j])) for j in large]
            c = np.concatenate([c[counts > 0], *halves]).astype(np.float32)
    return c


def _graph(c: np.ndarray) -> np.ndarray:
    """Of each centroid its nearest DEGREE others, and a few spread over all that keep the graph in one piece."""
    near = [np.argsort(-(c[i : i + 512] @ c.T), axis=1)[:, 1 : DEGREE + 1] for i in range(0, len(c), 512)]
    far = (np.arange(len(c))[:, None] * 7919 + np.array([1, len(c) // 3 + 1, len(c) // 2 + 1])) % len(c)
    return np.c_[np.concatenate(near), far]


def search_centroids(index: Index, x: np.ndarray, ratio: float) -> np.ndarray:
    """Distances (rows of x by centroids) of the centroids within ratio of the nearest, as the graph leads there; else infinite.

    From a few entries, each row goes on from its nearest centroids not yet left, while these are within the ratio.
    """
    c, graph = index.centroids, index.graph
    dist = np.full((len(x), len(c)), np.inf, np.float32)
    left = np.zeros(dist.shape, bool)
    start = np.unique(np.linspace(0, len(c) - 1, ENTRIES).astype(int))
    dist[:, start] = np.sqrt(np.maximum(2 - 2 * x @ c[start].T, 0))
    steps = 0
    while True:
        best = dist.min(axis=1, keepdims=True)
        open_ = np.where(left, np.inf, dist)
        width = min(8, len(c))
        go = np.argpartition(open_, width - 1, axis=1)[:, :width]
        rows = np.repeat(np.arange(len(x)), width)
        go = go.ravel()
        limit = ratio * best[rows, 0] + 1e-6
        # the way to the nearest may first lead past centroids that are not near
        ok = (open_[rows, go] <= limit) if steps > 6 else np.isfinite(open_[rows, go])
        if not ok.any():
            return np.where(dist <= ratio * best + 1e-6, dist, np.inf)
        rows, go = rows[ok], go[ok]
        left[rows, go] = True
        to = graph[go]
        rows, to = np.repeat(rows, to.shape[1]), to.ravel()
        fresh = np.isinf(dist[rows, to])
        key = np.unique(rows[fresh] * np.int64(len(c)) + to[fresh])
        rows, to = key // len(c), key % len(c)
        for i in range(0, len(rows), 1 << 16):
            r, t = rows[i : i + (1 << 16)], to[i : i + (1 << 16)]
            dist[r, t] = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", x[r], c[t]), 0))
        steps += 1


def fit(vectors: DataFrame, kind: str = "f4") -> Index | None:
    """The index of (gid, v), v the bytes of its components: on at most FIT rows, those of least hash. None without rows."""
    n = vectors.count()
    if not n:
        return None
    rows = vectors.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(FIT).collect()
    x = np.stack([np.frombuffer(r.v, kind) for r in rows]).astype(np.float64)

    def largest(batches):
        for b in batches:
            norms = [float(np.linalg.norm(np.frombuffer(v, kind).astype(np.float64))) for v in b.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([max(norms)] if norms else [], pa.float64())], ["norm"])

    norm = vectors.select("v").mapInArrow(largest, "norm double").agg(F.max("norm")).first()[0]
    lifted = _unit(_lift(x, norm)).astype(np.float32)
    k = int(min(max(1, n // LIST), LISTS, len(lifted)))
    c = _centroids(lifted, k)
    return Index(c, _graph(c), norm, kind)


def clean(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vec) of rows that take part: vectors that aren't null or zero, hold no null, NaN or infinity, and have the length
    that most of them have (the smaller of two such), as there is no inner product of vectors of two lengths. Components of single
    precision stay so, all others become doubles."""
    v = F.col(vector_col)
    if "array<float>" not in table.select(v).schema.simpleString():
        v = v.cast("array<double>")
    rows = table.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("vec")).filter("vec_id is not null and size(vec) > 0")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(finite & F.exists("vec", lambda x: x != 0)).withColumn("n", F.size("vec"))
    usual = rows.groupBy("n").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).select("n")
    return rows.join(F.broadcast(usual), "n", "left_semi").select("vec_id", "vec")


def _packed(rows: DataFrame, kind: str) -> DataFrame:
    def run(batches):
        for b in batches:
            flat = [np.asarray(x, kind).tobytes() for x in b.column("vec").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(flat, pa.binary())], ["vec_id", "v"])

    return rows.mapInArrow(run, "vec_id bigint, v binary")


def _routed(rows: DataFrame, index: Index, ratio: float, copies: int | None = None) -> DataFrame:
    """(list, gid, v, near): a row for each list that a vector (with copies: to store) or a query goes to; near: one of its FIRST."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        ix = shared.value
        for b in batches:
            gids, vs = b.column("gid").to_numpy(zero_copy_only=False), b.column("v").to_pylist()
            for i in range(0, len(vs), 256):
                part = vs[i : i + 256]
                x = np.frombuffer(b"".join(part), ix.kind).reshape(len(part), -1).astype(np.float64)
                lifted = _lift(x, ix.norm) if copies else _unit(np.c_[x, np.zeros(len(x))]).astype(np.float32)
                dist = search_centroids(ix, lifted, ratio)

                def cutoff(n, dist=dist):
                    return np.partition(dist, n - 1, axis=1)[:, n - 1 : n] if n < dist.shape[1] else np.full((len(dist), 1), np.inf)

                if copies:
                    dist = np.where(dist <= cutoff(copies), dist, np.inf)
                near = dist <= cutoff(FIRST)
                row, to = np.nonzero(np.isfinite(dist))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(gids[i + row]), pa.array([part[r] for r in row], pa.binary()), pa.array(near[row, to])], ["list", "gid", "v", "near"])

    return rows.select("gid", "v").mapInArrow(run, "list int, gid bigint, v binary, near boolean")


def _scored(keep: int, kind: str):
    def run(lists: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = {"qid": [], "gid": [], "score": []}
        if len(lists) and len(asks):
            x = np.frombuffer(b"".join(lists.v), kind).reshape(len(lists), -1).astype(np.float64)
            q = np.frombuffer(b"".join(asks.v), kind).reshape(len(asks), -1).astype(np.float64)
            scores, gids = q @ x.T, lists.gid.to_numpy()
            # products round otherwise than the exact sums that `least` comes from
            least = asks.least.to_numpy()[:, None]
            scores[scores < least - 1e-9 * np.maximum(np.abs(np.where(np.isfinite(least), least, 0.0)), 1.0)] = -np.inf
            for i, qid in enumerate(asks.gid.to_numpy()):
                at = np.flatnonzero(np.isfinite(scores[i]))
                if len(at) > keep:
                    at = at[np.lexsort((gids[at], -scores[i][at]))[:keep]]
                out["qid"] += [qid] * len(at)
                out["gid"] += gids[at].tolist()
                out["score"] += [fsum(q[i] * x[j]) for j in at]  # of floats the products are exact, and the sum is for all
        return pd.DataFrame(out).astype({"qid": "int64", "gid": "int64", "score": "float64"})

    return run


def _read(lists: DataFrame, reads: DataFrame, keep: int, kind: str) -> DataFrame:
    """(qid, gid, score): of each list and each query that reads it, the best `keep` that score no less than `least`."""
    sizes = lists.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    sizes = cut(sizes.join(reads.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("reads")), "list"))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("gid"), F.col(own)).alias(f"in_{own}")
        side = side.join(F.broadcast(sizes), "list").select("list", "gid", "v", *(["least"] if own == "reads" else []), mine, other)
        return side.withColumn(f"in_{other}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1))).drop(other)

    key = ["list", "in_parts", "in_reads"]
    pairs = dealt(lists, "parts", "reads").groupBy(*key).cogroup(dealt(reads, "reads", "parts").groupBy(*key))
    return pairs.applyInPandas(_scored(keep, kind), "qid bigint, gid bigint, score double")


def neighbours(table: DataFrame, queries: DataFrame | None = None, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the k nearest found, by inner product in double precision, ties to the smaller vec_id.

    Queries are the rows whose id is divisible by `every`, or those of `queries` (vec_id). Rows that clean() leaves out take no part.
    A query is no candidate of its own; an id that comes twice with one vector counts once, with several vectors as so many
    rows. An empty table gives no rows. Other columns aren't read.
    """
    cleaned = clean(table, id_col, vector_col)
    kind = "f4" if "array<float>" in cleaned.schema.simpleString() else "f8"
    rows = cut(_packed(cleaned, kind).distinct())
    asks = rows.filter(F.col("vec_id") % every == 0) if queries is None else rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    # of equal vectors the k + 1 least ids are enough: one of them may be the query
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    groups = rows.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    groups = cut(groups.select(F.col("ids")[0].alias("gid"), "v", "ids"))
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    index = fit(groups, kind)
    if index is None:
        return rows.sparkSession.createDataFrame([], schema)
    asks = cut(asks.join(groups.select("v", "gid"), "v").select(F.col("vec_id").alias("query_id"), "gid"))
    distinct = groups.join(asks.select("gid").distinct(), "gid", "left_semi")
    lists = cut(_routed(groups, index, CLOSE, COPIES).drop("near"))
    reads = cut(_routed(distinct, index, READ))
    first = cut(_read(lists, reads.filter("near").withColumn("least", F.lit(float("-inf"))), k + 1, kind).distinct())
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "gid"))
    least = first.withColumn("r", nth).filter(F.col("r") == k + 1).select(F.col("qid").alias("gid"), F.col("score").alias("least"))
    later = reads.filter("not near").join(least, "gid", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    found = first.union(_read(lists, later, k + 1, kind)).distinct()
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "gid")
    found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    each = found.join(groups.select("gid", "ids"), "gid").select("qid", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    each = each.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    own = each.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("all"))
    ranked = asks.join(own, asks.gid == own.qid)
    others = F.slice(F.filter("all", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    ranked = ranked.select("query_id", F.posexplode(others).alias("rank", "x"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
