"""Tables kept up with a stream at a cost that follows the batch, not the table.

A table is kept as rows that merge (counts, minima, maxima by a key) in generations: a base that compaction writes, and a delta of each batch since.
Rows of a generation lie in buckets by key. A batch reads the buckets of its own keys alone; buckets are held to about TARGET rows, for compaction
makes more of them as the table grows, so a batch reads no more than a bucket for each of its keys, however large the table. Compaction runs
when the deltas have grown to half the base, so its cost is a constant share of what was written.

Each batch leaves its changes: the row as it was (op -) and as it is (op +). A row that comes late, for a day long past too, changes the
row of that day like any other, so any order of arrival ends in the same table. A batch that is run again replaces itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G

#: Rows of a bucket, about, buckets at most, and deltas that stand beside the base at most.
TARGET, BUCKETS, DELTAS = 20_000, 65_536, 8
#: Keys of a batch that are sent to every task.
BROADCAST = 100_000


@dataclass(frozen=True)
class Kept:
    """What is kept: `rows` makes of input rows rows that merge by `key`, by the aggregates `merge` gives; `result` makes the table of them, a
    row for each `by`, which is a part of the key. What has the same `by` lies in one bucket. A `result` that gives the same of rows that aren't merged
    gets them as they are."""

    by: tuple[str, ...]
    key: tuple[str, ...]
    rows: Callable[[DataFrame], DataFrame]
    merge: Callable[[], list[Column]]
    result: Callable[[DataFrame], DataFrame]
    unmerged: bool = False


@dataclass(frozen=True)
class Layout:
    """The generations that count: names in order, the last batch that is in the base, and the number of buckets."""

    names: list[str]
    base: int
    buckets: int


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _done(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def _cover(ranges: list[tuple[int, int, str]], after: int) -> list[str]:
    """Names of ranges (first, last, name) of batches that follow `after` without overlap, the longer one where two begin alike."""
    names = []
    for a, b, n in sorted(ranges, key=lambda x: (x[0], -x[1])):
        if a > after:
            names.append(n)
            after = b
    return names


def layout(spark: SparkSession, store: str) -> Layout:
    """The newest whole base, and the whole deltas after it; of deltas that overlap, as after a merge, the longer one."""
    found = [(m[1], int(m[2]), int(m[3]), m[0]) for n in _names(spark, store) if (m := re.fullmatch(r"(base|delta)-(\d+)-(\d+)", n))]
    bases = sorted((a, b, n) for kind, a, b, n in found if kind == "base" and _done(spark, f"{store}/{n}/state"))
    base, buckets, names = (bases[-1][0], bases[-1][1], [bases[-1][2]]) if bases else (-1, 1, [])
    deltas = [(a, b, n) for kind, a, b, n in found if kind == "delta" and a > base and _done(spark, f"{store}/{n}/changes")]
    return Layout(names + _cover(deltas, base), base, buckets)


def _read(spark: SparkSession, store: str, names: list[str], buckets: set[int] | None = None) -> DataFrame | None:
    """Rows of the generations, of some buckets alone: only their folders are listed and read."""
    out = None
    for n in names:
        root = f"{store}/{n}/state"
        there = [x for x in _names(spark, root) if x.startswith("bucket=") and (buckets is None or int(x[7:]) in buckets)]
        if there:
            rows = spark.read.option("basePath", root).parquet(*[f"{root}/{x}" for x in sorted(there)]).drop("bucket")
            out = rows if out is None else out.unionByName(rows)
    return out


def _merged(rows: DataFrame, kept: Kept) -> DataFrame:
    return rows.groupBy(*kept.key).agg(*kept.merge())


def _result(rows: DataFrame, kept: Kept) -> DataFrame:
    return kept.result(rows if kept.unmerged else _merged(rows, kept))


def _write(rows: DataFrame, kept: Kept, buckets: int, path: str) -> None:
    """Rows in folders by bucket. A bucket goes to one task as long as it is small; what has more rows, as a first batch or one much confirmed fact, is split over many."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*kept.by), F.lit(buckets)).cast("int"))
    dealt.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _same(left: DataFrame, right: DataFrame, key: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for k in key:
        out &= left[k].eqNullSafe(right[k])
    return out


def touched(spark: SparkSession, store: str, kept: Kept, at: Layout, new: DataFrame) -> DataFrame | None:
    """The rows held so far under the keys of a batch, from the buckets of these keys. Their numbers, one for each of at most BUCKETS buckets, go to the driver."""
    keys = new.select(*[F.col(k).alias(f"__{k}") for k in kept.by]).distinct()
    number = F.pmod(F.xxhash64(*keys.columns), F.lit(at.buckets)).cast("int").alias("bucket")
    numbers = {r[0]: r[1] for r in keys.groupBy(number).count().collect()}
    held = _read(spark, store, at.names, set(numbers))
    if held is None:
        return None
    if sum(numbers.values()) <= BROADCAST:  # what is held isn't shuffled by its keys, of which some may have most rows
        keys = F.broadcast(keys)
    same = F.lit(True)
    for k in kept.by:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return held.join(keys, same, "left_semi")


def apply(batch: DataFrame, n: int, store: str, kept: Kept) -> None:
    """Takes the rows of batch n in. A batch that the base already holds is passed over, one that was written before is written anew."""
    spark = batch.sparkSession
    at = layout(spark, store)
    if n <= at.base:
        return
    at = Layout([x for x in at.names if x != f"delta-{n}-{n}"], at.base, at.buckets)
    path = f"{store}/delta-{n}-{n}"
    _write(_merged(kept.rows(batch), kept), kept, at.buckets, f"{path}/state")
    new = _read(spark, store, [f"delta-{n}-{n}"])
    if new is None:  # an empty batch
        return
    held = touched(spark, store, kept, at, new)
    change = _result(new if held is None else new.unionByName(held), kept).withColumn("op", F.lit("+"))
    if held is not None:
        row = F.struct(*[c for c in change.columns if c != "op"])
        both = change.unionByName(_result(held, kept).withColumn("op", F.lit("-")))
        was, is_ = (F.max(F.when(F.col("op") == o, row)) for o in "-+")
        both = both.groupBy(*kept.by).agg(was.alias("was"), is_.alias("is")).filter("not was <=> is")
        sides = F.array(F.struct(F.lit("-").alias("op"), F.col("was").alias("r")), F.struct(F.lit("+").alias("op"), F.col("is").alias("r")))
        change = both.select(F.explode(sides).alias("v")).filter("v.r is not null").select("v.r.*", "v.op")
    change.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/changes")
    at = layout(spark, store)
    if _due(spark, store, at):
        compact(spark, store, kept)


def _bytes(spark: SparkSession, store: str, names: list[str]) -> int:
    total = 0
    for n in names:
        fs, p = _fs(spark, f"{store}/{n}/state")
        total += fs.getContentSummary(p).getLength()
    return total


def _due(spark: SparkSession, store: str, at: Layout) -> bool:
    deltas = [n for n in at.names if n.startswith("delta")]
    return len(deltas) > DELTAS or len(deltas) > 1 and 2 * _bytes(spark, store, deltas) >= _bytes(spark, store, [n for n in at.names if n.startswith("base")])


def compact(spark: SparkSession, store: str, kept: Kept) -> None:
    """Merges deltas: small ones into one delta, those that have grown to half the base into a new base, with so many buckets that each holds about TARGET rows.

    What is replaced is deleted after what replaces it is whole, its changes are kept; a compaction that was broken off counts for nothing.
    """
    at = layout(spark, store)
    deltas = [n for n in at.names if n.startswith("delta")]
    if not deltas:
        return
    first, last = deltas[0].split("-")[1], int(deltas[-1].split("-")[2])
    base = [n for n in at.names if n.startswith("base")]
    minor = bool(base) and 2 * _bytes(spark, store, deltas) < _bytes(spark, store, base)
    rows = _read(spark, store, deltas if minor else at.names)
    if rows is None:
        return
    merged = _merged(rows, kept)
    feed = spark.read.parquet(*[f"{store}/{n}/changes" for n in deltas])
    if minor:
        _write(merged, kept, at.buckets, f"{store}/delta-{first}-{last}/state")
        feed.write.mode("overwrite").parquet(f"{store}/delta-{first}-{last}/changes")
        gone = deltas
    else:
        n = rows.count()
        buckets = min(BUCKETS, 1 << max(0, (n // TARGET).bit_length()))
        feed.write.mode("overwrite").parquet(f"{store}/log/{first}-{last}")
        _write(merged, kept, buckets, f"{store}/base-{last}-{buckets}/state")
        gone = at.names
    for name in gone:
        if name != f"delta-{first}-{last}":
            fs, p = _fs(spark, f"{store}/{name}")
            fs.delete(p, True)


def current(spark: SparkSession, store: str, kept: Kept) -> DataFrame:
    """The table as the last batch left it: what the batch form gives of all rows."""
    return _result(_read(spark, store, layout(spark, store).names), kept)


def changes(spark: SparkSession, store: str) -> DataFrame:
    """All changes so far, with the batch that made them."""
    at = layout(spark, store)
    logs = [(int(n.split("-")[0]), int(n.split("-")[1]), n) for n in _names(spark, f"{store}/log")]
    logs = _cover([x for x in logs if x[1] <= at.base and _done(spark, f"{store}/log/{x[2]}")], -1)
    return spark.read.parquet(*[f"{store}/{n}/changes" for n in at.names if n.startswith("delta")], *[f"{store}/log/{n}" for n in logs])


def upserts(stream: DataFrame, store: str, checkpoint: str, kept: Kept):
    """A query that takes all that is there of a stream in, and ends."""
    return stream.writeStream.foreachBatch(lambda batch, n: apply(batch, n, store, kept)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _confirmations(occ: DataFrame) -> DataFrame:
    return G.with_keys(occ).select("fact_key", "url", "domain", F.struct("seq", "subject", "predicate", "object").alias("first"), F.lit(1).cast("bigint").alias("occurrences"))


def _facts(rows: DataFrame) -> DataFrame:
    # what is counted as different goes apart from the rest: together each row would be sorted three times at its full width
    n = rows.groupBy("fact_key").agg(F.count_distinct("domain").alias("domains"), F.count_distinct("url").alias("urls"))
    f = rows.groupBy("fact_key").agg(F.min("first").alias("f"), F.sum("occurrences").alias("occurrences")).join(n, "fact_key")
    digest = T.fact_hash(F.col("f.subject"), F.col("f.predicate"), F.col("f.object")).alias("fact_hash")
    return f.select("fact_key", digest, F.col("f.subject").alias("subject"), F.col("f.predicate").alias("predicate"), F.col("f.object").alias("object"), "occurrences", "domains", "urls", (F.col("domains") >= G.QUORUM).alias("verified"))


#: Facts of occurrences (graph.facts), kept as confirmations by url and domain.
FACTS = Kept(("fact_key",), ("fact_key", "url", "domain"), _confirmations, lambda: [F.min("first").alias("first"), F.sum("occurrences").alias("occurrences")], _facts, unmerged=True)


def _seen(events: DataFrame) -> DataFrame:
    whole = events.dropna(subset=["subject", "predicate", "object"])
    keyed = whole.withColumn("fact_hash", T.fact_hash(F.col("subject"), F.col("predicate"), F.col("object"))).withColumn("day", F.to_date("ts"))
    return keyed.select("fact_hash", "day", F.struct("ts", "subject", "predicate", "object", "source_domain").alias("first"), F.col("ts").alias("last_seen_at"), F.lit(1).cast("bigint").alias("replays"))


def _episodes(rows: DataFrame) -> DataFrame:
    f = [F.col(f"first.{c}").alias(c) for c in ("subject", "predicate", "object", "source_domain")]
    return rows.select("fact_hash", "day", *f, F.col("first.ts").alias("created_at"), "last_seen_at", "replays")


#: Episodes of events by fact and day: a late event re-opens its day.
EPISODES = Kept(("fact_hash", "day"), ("fact_hash", "day"), _seen, lambda: [F.min("first").alias("first"), F.max("last_seen_at").alias("last_seen_at"), F.sum("replays").alias("replays")], _episodes)
