"""Near-duplicate vectors over a robust-pruned flat graph, with counts of links that need no list of all pairs.

Equal vectors are one node. Nodes within half the threshold's angle of a leader join its ball: any two of a ball are linked for certain, so a large
group of near copies costs no pairs. Leaders are dealt to overlapping shards (nearest centroids), each shard builds a graph
whose edges robust pruning thins out, and the lists of a leader from all its shards are united. Every leader then searches its
shards along the united lists, from the medoid and from where it stands itself: greedy, with a beam, and on through whatever lies
within range, however much that is. Pairs of balls found are all linked, or verified vector by vector in packs of bounded size.
An audit counts the links of some vectors against all rows; if too few were found, the search is done again over more shards.
"""

from __future__ import annotations

from math import acos, cos

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .posting_ann import _centroids, _packed, _unit, clean
from .shared import components, cut

#: Nodes that the centroids are fitted on, at most. Every row is searched.
FIT = 16_384
#: Leaders of a shard, about, and shards at most (their centroids are sent to every worker); a shard is cut into blocks of BLOCK.
SHARD, SHARDS, BLOCK = 1_024, 4_096, 2_048
#: Shards that a leader stands in at first.
COPIES = 3
#: Nearest leaders that robust pruning chooses from, lists at most, and the factor by which a kept neighbour must be nearer to one that goes.
NEAREST, DEGREE, SPREAD = 64, 24, 1.2
BEAM, SLACK = 16, 0.05
#: Vectors of a pack that is verified against another; vectors that the audit counts the links of, recall that it asks for, widenings at most.
PACK, AUDIT, RECALL, WIDER = 512, 256, 0.99, 3
ROUNDS = 3


def _units(vectors, kind: str) -> np.ndarray:
    """Unit vectors in double precision, of bytes."""
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    return _unit(x / np.abs(x).max(axis=1, keepdims=True)) if len(x) else x


def _angles(c: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(c, -1.0, 1.0))


def _fit(nodes: DataFrame, kind: str, least: float) -> np.ndarray:
    """Centroids of at most FIT nodes (those of least hash); of nodes linked to an earlier one none counts, so that crowds draw no centroids."""
    n = nodes.count()
    rows = nodes.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(FIT).collect()
    x = _units([r.v for r in rows], kind)
    alone = []
    x = x.astype(np.float32)
    for i in range(0, len(x), 256):
        c = x[i : i + 256] @ x[: i + 256].T
        c[np.arange(len(c))[:, None] + i <= np.arange(c.shape[1])[None, :]] = -1
        alone.append(c.max(axis=1) < least)
    x = x[np.concatenate(alone)]
    return _centroids(x, int(min(max(1, n // SHARD), SHARDS, len(x))))


def _dealt(rows: DataFrame, centroids: np.ndarray, copies: int, kind: str) -> DataFrame:
    """rows with `shard`: one of each for its `copies` nearest centroids."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    names = rows.columns

    def run(batches):
        c = shared.value
        for b in batches:
            v = b.column("v").to_pylist()
            for i in range(0, len(v), 1024):
                near = _units(v[i : i + 1024], kind) @ c.T
                k = min(copies, near.shape[1])
                to = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < near.shape[1] else np.tile(np.arange(k), (len(near), 1))
                part = b.slice(i, len(near)).take(pa.array(np.repeat(np.arange(len(near)), k)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(to.ravel().astype(np.int32))], [*names, "shard"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", shard int")


def _blocks(rows: DataFrame, size: int, salt: int) -> DataFrame:
    """rows with `block` and `blocks`: shards cut into so many blocks of about `size`."""
    n = rows.groupBy("shard").agg(F.ceil(F.count("*") / size).alias("blocks"))
    return rows.join(n, "shard").withColumn("block", F.pmod(F.xxhash64("gid", F.lit(salt)), F.col("blocks")))


def _absorb(kind: str, half: float):
    """Which leaders of a block join another: those whose whole ball lies within half the angle of it; the one with most such goes first."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("gid", ignore_index=True)
        u, gid, radius = _units(part.v.tolist(), kind), part.gid.to_numpy(), part.radius.to_numpy()
        into = gid.copy()
        close = (u @ u.T) >= cos(half)
        crowd = close.sum(axis=1)
        free = crowd > 1
        reach = radius.copy()
        for i in np.argsort(-crowd, kind="stable"):
            if crowd[i] < 2:
                break
            if not free[i]:
                continue
            j = np.flatnonzero(close[i] & free)
            a = _angles(u[j] @ u[i]) + radius[j]
            ok = (a <= half - 1e-9) & (j != i)
            into[j[ok]], free[j[ok]], free[i] = gid[i], False, False
            if ok.any():
                reach[i] = max(reach[i], a[ok].max())
        return pd.DataFrame({"gid": gid, "into": into, "reach": reach})

    return run


def balls(nodes: DataFrame, centroids: np.ndarray, kind: str, least: float) -> tuple[DataFrame, DataFrame]:
    """(gid, leader) of every node, and the leaders (gid, v, radius): no two nodes of a ball are further apart than the threshold."""
    half = acos(least) / 2
    leaders = _dealt(nodes.select("gid", "v", F.lit(0.0).alias("radius")), centroids, 1, kind)
    member = None
    for turn in range(ROUNDS):
        blocked = cut(_blocks(leaders, BLOCK, turn))
        found = cut(blocked.select("shard", "block", "gid", "v", "radius").groupBy("shard", "block").applyInPandas(_absorb(kind, half), "gid bigint, into bigint, reach double"))
        step = found.select("gid", "into")
        member = step.select("gid", F.col("into").alias("leader")) if member is None else member.join(step.select(F.col("gid").alias("leader"), "into"), "leader").select("gid", F.col("into").alias("leader"))
        member = cut(member)
        moved, split = found.filter("gid <> into").count(), not blocked.filter("blocks > 1").isEmpty()
        leaders = blocked.drop("radius", "block", "blocks").join(found.filter("gid = into").select("gid", F.col("reach").alias("radius")), "gid").select("gid", "v", "radius", "shard")
        if not split or moved * 10 < found.count():
            break
    return member, cut(leaders.select("gid", "v", "radius"))


def pruned_graph(u: np.ndarray) -> list[np.ndarray]:
    """Of each unit vector its neighbours: of the NEAREST the nearest stays, those that lie clearly nearer to it go, and so on to DEGREE; and
    those that keep it as theirs, up to DEGREE more of the nearest."""
    n = len(u)
    if n < 2:
        return [np.zeros(0, int)] * n
    c = (u @ u.T).astype(np.float32)
    np.fill_diagonal(c, -2)
    k = min(NEAREST, n - 1)
    near = np.argpartition(-c, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(c, near, 1), axis=1, kind="stable"), 1)
    far = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(c, near, 1), 0))
    alive, kept, rows = np.ones(near.shape, bool), np.zeros(near.shape, bool), np.arange(n)
    for _ in range(DEGREE):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        kept[rows[some], first[some]] = True
        chosen = near[rows, first]
        between = np.sqrt(np.maximum(2 - 2 * c[chosen[:, None], near], 0))
        between[near == chosen[:, None]] = 0
        alive &= ~((SPREAD * between <= far) | (np.arange(k)[None, :] == first[:, None])) | ~some[:, None]
    src, at = np.nonzero(kept)
    dst = near[src, at]
    order = np.lexsort((-c[dst, src], dst))
    back_to, back_from = dst[order], src[order]
    starts = np.searchsorted(back_to, rows)
    ends = np.minimum(np.searchsorted(back_to, rows, side="right"), starts + DEGREE)
    ring = (rows + 1) % n
    return [np.unique(np.r_[near[i][kept[i]], back_from[starts[i] : ends[i]], ring[i]]) for i in range(n)]


def _graph(kind: str):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("gid", ignore_index=True)
        gid = part.gid.to_numpy()
        lists = pruned_graph(_units(part.v.tolist(), kind))
        return pd.DataFrame({"gid": gid, "near": [gid[x].tolist() for x in lists]})

    return run


def range_search(u: np.ndarray, lists: list[np.ndarray], q: np.ndarray, entries: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) of the vectors u met whose cosine with q is no less than wide: greedy from each query's entries, with a beam of the best BEAM,
    and on from everything within range (and SLACK more), so the result is as long as the range is full."""
    degree = np.array([len(x) for x in lists])
    flat, start = np.concatenate([*lists, np.zeros(0, int)]).astype(np.int64), np.r_[0, np.cumsum(degree)][:-1]
    seen, left = np.zeros((len(q), len(u)), bool), np.zeros((len(q), len(u)), bool)
    c = np.full((len(q), len(u)), -2.0)
    on = np.cos(np.minimum(_angles(wide) + SLACK, np.pi))
    rows, to = np.repeat(np.arange(len(q)), entries.shape[1]), entries.ravel()
    while True:
        fresh = ~seen[rows, to]
        key = np.unique(rows[fresh] * np.int64(len(u)) + to[fresh])
        rows, to = key // len(u), key % len(u)
        seen[rows, to] = True
        for i in range(0, len(rows), 1 << 16):
            r, t = rows[i : i + (1 << 16)], to[i : i + (1 << 16)]
            c[r, t] = np.einsum("ij,ij->i", q[r], u[t])
        best = np.partition(c, -BEAM, axis=1)[:, -BEAM] if len(u) > BEAM else np.full(len(q), -2.0)
        rows, at = np.nonzero(seen & ~left & (c >= np.minimum(best, on)[:, None]))
        if not len(rows):
            rows, at = np.nonzero(seen & (c >= wide[:, None]))
            return rows, at
        rows, at = rows[: 1 << 15], at[: 1 << 15]
        left[rows, at] = True
        n = degree[at]
        to = flat[np.repeat(start[at] - np.r_[0, np.cumsum(n)][:-1], n) + np.arange(n.sum())]
        rows = np.repeat(rows, n)


def _search(kind: str, least: float):
    angle = acos(least)

    def run(here: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(here) and len(asks):
            here = here.sort_values("gid", ignore_index=True)
            u, gid, radius = _units(here.v.tolist(), kind), here.gid.to_numpy(), here.radius.to_numpy()
            lists = []
            for x in here.near:
                at = np.minimum(np.searchsorted(gid, x), len(gid) - 1)
                lists.append(at[gid[at] == np.asarray(x)])
            medoid = int(np.argmax(u @ u.sum(axis=0)))
            for i in range(0, len(asks), 256):
                part = asks.iloc[i : i + 256]
                q, ids, r = _units(part.v.tolist(), kind), part.gid.to_numpy(), part.radius.to_numpy()
                own = np.minimum(np.searchsorted(gid, ids), len(gid) - 1)
                own[gid[own] != ids] = medoid
                wide = np.cos(np.minimum(angle + r + radius.max() + 1e-9, np.pi))
                row, to = range_search(u, lists, q, np.c_[np.full(len(q), medoid), own], wide)
                c = np.einsum("ij,ij->i", q[row], u[to])
                reach = r[row] + radius[to]
                apart = _angles(c)
                ok = (ids[row] != gid[to]) & np.where(reach == 0, c >= least, apart <= angle + reach + 1e-9)
                whole = np.where(reach == 0, c >= least, apart + reach <= angle - 1e-9)
                a, b = ids[row][ok], gid[to][ok]
                out.append(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "whole": whole[ok]}))
        return pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "whole": np.zeros(0, bool)})

    return run


def ball_pairs(leaders: DataFrame, centroids: np.ndarray, kind: str, least: float, copies: int) -> DataFrame:
    """(a, b, whole), a < b: pairs of balls found that may have links between them; whole: all of one with all of the other."""
    held = cut(_blocks(_dealt(leaders, centroids, copies, kind), BLOCK, 7))
    lists = held.select("shard", "block", "gid", "v").groupBy("shard", "block").applyInPandas(_graph(kind), "gid bigint, near array<bigint>")
    united = lists.groupBy("gid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
    # every block of a shard meets the leaders of every block of it
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    here = held.join(united, "gid").select("shard", "block", other.alias("ask"), "gid", "v", "radius", "near")
    asks = held.select("shard", "block", other, "gid", "v", "radius").toDF("shard", "ask", "block", "gid", "v", "radius")
    key = ["shard", "block", "ask"]
    return here.groupBy(*key).cogroup(asks.groupBy(*key)).applyInPandas(_search(kind, least), "a bigint, b bigint, whole boolean").distinct()


def _verified(pairs: DataFrame, members: DataFrame, kind: str, least: float) -> DataFrame:
    """(gid, links) of each vector with links to the other ball of a pair (a, b), and (u, v) of each pair with links; members: leader, gid, v, n."""
    size = members.groupBy("leader").agg(F.ceil(F.count("*") / PACK).alias("packs"))
    packed = members.join(size, "leader").withColumn("pack", F.pmod(F.xxhash64("gid"), F.col("packs")))
    packed = packed.groupBy("leader", "pack").agg(F.collect_list(F.struct("gid", "v", "n")).alias("m"))
    one, two = packed.select(F.col("leader").alias("a"), F.col("m").alias("x")), packed.select(F.col("leader").alias("b"), F.col("m").alias("y"))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                x, y = batch.column("x")[row].values, batch.column("y")[row].values
                linked = _units(x.field("v").to_pylist(), kind) @ _units(y.field("v").to_pylist(), kind).T >= least
                if not linked.any():
                    continue
                n, m = x.field("n").to_numpy(), y.field("n").to_numpy()
                gid = [*x.field("gid").to_pylist(), *y.field("gid").to_pylist(), None]
                links = [*(linked @ m).tolist(), *(linked.T @ n).tolist(), None]
                ends = [[None] * (len(gid) - 1) + [batch.column(k)[row].as_py()] for k in ("a", "b")]
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()) for t in (gid, links, *ends)], ["gid", "links", "u", "v"])

    both = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "gid bigint, links bigint, u bigint, v bigint")


def _count(nodes: DataFrame, asked: list, kind: str, least: float) -> dict[int, int]:
    """Links of the asked nodes (gid, v, n), counted against all nodes; there are AUDIT of them at most."""
    if not asked:
        return {}
    shared = nodes.sparkSession.sparkContext.broadcast(_units([r.v for r in asked], kind))

    def run(batches):
        total = np.zeros(len(shared.value), np.int64)
        for b in batches:
            v, n = b.column("v").to_pylist(), b.column("n").to_numpy()
            for i in range(0, len(v), 1024):
                total += (shared.value @ _units(v[i : i + 1024], kind).T >= least) @ n[i : i + 1024]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "links"])

    rows = nodes.select("v", "n").mapInArrow(run, "at bigint, links bigint").groupBy("at").agg(F.sum("links").alias("links")).collect()
    return {asked[r["at"]].gid: r.links - 1 for r in rows}


def audited(nodes: DataFrame, linked: DataFrame, kind: str, least: float) -> float:
    """Links found of links there are, over AUDIT nodes: half of all nodes, half of those with links, each those of least hash. linked: gid, links."""
    both = nodes.select("gid", "v", "n").join(linked, "gid")
    order = [F.xxhash64("gid", F.lit(1)), F.col("gid")]
    asked = both.orderBy(*order).limit(AUDIT // 2).collect() + both.filter("links > 0").orderBy(*order).limit(AUDIT // 2).collect()
    asked = list({r.gid: r for r in asked}.values())
    true = _count(nodes, asked, kind, least)
    total = sum(true.values())
    return sum(min(r.links, true[r.gid]) for r in asked) / total if total else 1.0


def near_duplicates(table: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector: others with a cosine of `least` or more, the least vec_id reachable by such links, and
    whether it is that one.

    Rows that clean() leaves out (null, zero, with null or non-finite components, of another length than most) link with nothing. Rows that
    repeat both id and vector are one; an id with several vectors is as many. A null id is named by the least of the others, and kept
    where there is none. An empty table gives no rows. Other columns aren't read.
    """
    cleaned = clean(table.filter(F.col(id_col).isNotNull()), id_col, vector_col)
    kind = "f4" if "array<float>" in cleaned.schema.simpleString() else "f8"
    # ids may be null here: clean() leaves those out, so they go by a number of their own
    every = table.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<float>" if kind == "f4" else "array<double>").alias("vec"))
    tagged = cut(every.distinct().withColumn("row", F.monotonically_increasing_id()))
    rows = cut(_packed(clean(tagged, "row", "vec"), kind).withColumnRenamed("vec_id", "row").join(tagged.select("row", "vec_id"), "row"))
    nodes = cut(rows.groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("first")).withColumn("gid", F.monotonically_increasing_id()))
    if nodes.isEmpty():
        return tagged.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    centroids = _fit(nodes, kind, least)
    member, leaders = balls(nodes, centroids, kind, least)
    members = cut(nodes.join(member, "gid").select("leader", "gid", "v", "n", "first"))
    weight = members.groupBy("leader").agg(F.sum("n").alias("weight"))
    copies = COPIES
    for turn in range(WIDER):
        pairs = cut(ball_pairs(leaders, centroids, kind, least, copies))
        whole, part = pairs.filter("whole").select("a", "b"), pairs.filter("not whole").select("a", "b")
        seen = cut(_verified(part, members, kind, least))
        both = whole.unionByName(whole.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = both.join(weight.select(F.col("leader").alias("b"), "weight"), "b").groupBy(F.col("a").alias("leader")).agg(F.sum("weight").alias("around"))
        some = seen.filter("gid is not null").groupBy("gid").agg(F.sum("links").alias("some"))
        links = members.join(weight, "leader").join(around, "leader", "left").join(some, "gid", "left")
        links = cut(links.select("gid", "leader", "first", (F.col("weight") - 1 + F.coalesce("around", F.lit(0)) + F.coalesce("some", F.lit(0))).alias("links")))
        if copies >= len(centroids) or turn == WIDER - 1 or audited(nodes, links.select("gid", "links"), kind, least) >= RECALL:
            break
        copies *= 2
    root = components(whole.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(seen.filter("u is not null").select("u", "v")))
    named = links.join(root, links.leader == root.node, "left").select("gid", "links", "first", F.coalesce("root", "leader").alias("root"))
    least_id = named.groupBy("root").agg(F.min("first").alias("component_id"))
    told = cut(named.join(least_id, "root").select("gid", "links", "component_id").join(nodes.select("gid", "v"), "gid").select("v", "links", "component_id"))
    linked = rows.join(told, "v").select("row", "links", "component_id")
    out = tagged.select("row", "vec_id").join(linked, "row", "left")
    own = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))
