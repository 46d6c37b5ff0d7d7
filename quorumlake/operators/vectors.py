"""Vectors: hashed embeddings, cosine similarity, exact top-k, upserts and entity resolution."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.small import checkpoints


def hash_embedding(text: Column, dim: int = 384) -> Column:
    """Signed feature hashing of the words (blake2b, of which Spark has no builtin), normalised; zeros without words."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in re.findall(r"\w+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % dim] += 1.0 if (h >> 63) & 1 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32))
        return pd.Series(out)

    return run(text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, zero or unequally long vectors."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 3, block: int = 1024, most: int = 32) -> DataFrame:
    """(query_id, vec_id, score, rank) of the k nearest by cosine, ties to the smaller id: exact, a stated query set against all rows, in blocks.

    queries: query_id, q (array); corpus: vec_id, v. Both are dealt into blocks of about `block` rows, each block of queries meets each of rows
    in a task of its own, and that gives the k best: nothing is collected, and what is shuffled again is k rows a query and block. There are `most` blocks
    a side at most, which then grow, so a row is copied so often and no more; a task multiplies its block of queries by tiles.
    """
    parts = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.count("*") / block).cast("int"))).alias("n")
    here, there = queries.agg(parts), corpus.agg(parts)
    own = here.select(F.col("n").alias("n_q")).crossJoin(there.select(F.col("n").alias("n_v")))  # one row

    def dealt(rows: DataFrame, key: str, mine: str, other: str) -> DataFrame:
        rows = rows.crossJoin(F.broadcast(own)).withColumn(f"in_{mine}", F.pmod(F.xxhash64(key), F.col(mine)))
        return rows.withColumn(f"in_{other}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other).cast("bigint") - 1))).drop("n_q", "n_v")

    def run(asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(asks) and len(rows):
            q, x = np.array(asks.q.tolist(), float), np.array(rows.v.tolist(), float)
            qn, xn, ids = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1), rows.vec_id.to_numpy()
            for lo in range(0, len(q), 256):
                s = q[lo : lo + 256] @ x.T / np.maximum(qn[lo : lo + 256, None] * xn, 1e-300)
                known = np.where(np.isnan(s), -np.inf, s)
                # all that are as near as the k-th, so that ties go by id
                last = np.partition(known, max(len(x) - k, 0), axis=1)[:, max(len(x) - k, 0)]
                for i, qid in enumerate(asks.query_id[lo : lo + 256]):
                    at = np.flatnonzero(known[i] >= last[i])
                    at = at[np.lexsort((ids[at], -s[i][at]))[:k]]
                    out["query_id"] += [qid] * len(at)
                    out["vec_id"] += ids[at].tolist()
                    out["score"] += s[i][at].tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    key = ["in_n_q", "in_n_v"]
    left = dealt(queries.select("query_id", "q"), "query_id", "n_q", "n_v").groupBy(*key)
    found = left.cogroup(dealt(corpus.select("vec_id", "v"), "vec_id", "n_v", "n_q").groupBy(*key)).applyInPandas(run, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def similar_names(names: DataFrame, threshold: float, tile: int = 1024) -> DataFrame:
    """(block, early, late, score) of names (block, name, first, v): pairs of a block of a cosine of `threshold` or more, the one seen first as `early`.

    A block is dealt into tiles of about `tile` names, and each pair of tiles is one product in a task of its own.
    """
    n = names.groupBy("block").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    dealt = names.join(n, "block").withColumn("mine", F.pmod(F.xxhash64("name"), F.col("tiles")))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1))
    rows = dealt.select("block", F.col("mine").alias("i"), every.alias("j"), "name", "first", "v").filter("i <= j")
    columns = dealt.select("block", every.alias("i"), F.col("mine").alias("j"), "name", "first", "v").filter("i <= j").toDF("block", "i", "j", "name", "first", "v")

    def unit(v: pd.Series) -> np.ndarray:
        x = np.array(v.tolist(), float)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"block": [], "early": [], "late": [], "score": []})
        s = unit(left.v) @ unit(right.v).T
        # products round otherwise than the threshold does
        a, b = np.nonzero(s >= threshold - 1e-9)
        l, r = left.iloc[a].reset_index(drop=True), right.iloc[b].reset_index(drop=True)
        before = (l["first"] < r["first"]) | ((l["first"] == r["first"]) & (l["name"] < r["name"]))
        keep = (l["name"] != r["name"]).to_numpy() & (before.to_numpy() if key[1] == key[2] else True)
        early = np.where(before, l["name"], r["name"])
        late = np.where(before, r["name"], l["name"])
        return pd.DataFrame({"block": key[0], "early": early, "late": late, "score": np.round(s[a, b], 9)})[keep]

    kind = names.schema["block"].dataType.simpleString()
    key = ["block", "i", "j"]
    return rows.groupBy(*key).cogroup(columns.groupBy(*key)).applyInPandas(run, f"block {kind}, early string, late string, score double")


def resolve_entities(names: DataFrame, threshold: float = 0.8) -> DataFrame:
    """names (block, seq, name, v) with `leader`: in order of first appearance, the nearest earlier leader of the block within the threshold, else itself
    (of equally near ones the earliest).

    As if one name after the other were looked at, but in rounds on the graph of similar names: a name leads once no earlier one that is like it is
    undecided or leads, and follows once one leads. Every round decides at least the earliest undecided name of each part of the graph, and
    in practice most of them. Names of null blocks or names come back as they are.
    """
    checkpoints(names.sparkSession)
    distinct = names.filter("block is not null and name is not null").groupBy("block", "name").agg(F.min("seq").alias("first"), F.min_by("v", "seq").alias("v")).checkpoint()
    edges = similar_names(distinct, threshold).checkpoint()
    # true leads, false follows, null is undecided; names that are like no earlier one lead from the start
    state = distinct.select("block", "name").join(edges.select("block", F.col("late").alias("name")).distinct().withColumn("waits", F.lit(True)), ["block", "name"], "left")
    state = state.select("block", "name", F.when(F.col("waits").isNull(), True).alias("leads")).checkpoint()
    while not state.filter("leads is null").isEmpty():
        open_ = edges.join(state.filter("leads is null").select("block", F.col("name").alias("late")), ["block", "late"])
        seen = open_.join(state.select("block", F.col("name").alias("early"), "leads"), ["block", "early"])
        now = seen.groupBy("block", F.col("late").alias("name")).agg(F.bool_or("leads").alias("led"), F.bool_or(F.col("leads").isNull()).alias("open"))
        told = F.when(F.col("led"), False).when(~F.col("open"), True)
        state = state.join(now, ["block", "name"], "left").select("block", "name", F.coalesce("leads", told).alias("leads")).checkpoint()
    near = edges.join(state.filter("leads").select("block", F.col("name").alias("early")), ["block", "early"])
    near = near.join(distinct.select("block", F.col("name").alias("early"), "first"), ["block", "early"])
    best = near.groupBy("block", F.col("late").alias("name")).agg(F.min_by("early", F.struct(-F.col("score"), "first", "early")).alias("leader"))
    best = best.join(state.filter("not leads"), ["block", "name"], "left_semi")
    return names.select("block", "seq", "name").join(best, ["block", "name"], "left").select("block", "seq", "name", F.coalesce("leader", "name").alias("leader"))
