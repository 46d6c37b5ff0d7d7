"""What the operators of this subpackage share: written intermediates and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are broadcast at most. Beyond, documents are shuffled.
BROADCAST = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. On one machine (tests) a folder of our own where that is unset; on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quorumlake-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_MADE: list[list[tuple[SparkSession, str]]] = []


def cut(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends here, lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/quorumlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _MADE:
        _MADE[-1].append((df.sparkSession, path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what cut() wrote of these tables, once all that is read from them has been written elsewhere."""
    for t in tables:
        _delete(t.sparkSession, t._cut)


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """The table that make() gives, written by cut(); what was written on the way to it is deleted."""
    _MADE.append([])
    try:
        out = cut(make())
    finally:
        made = _MADE.pop()
    for spark, path in made:
        if path != out._cut:
            _delete(spark, path)
    if _MADE:
        _MADE[-1].append((out.sparkSession, out._cut))
    return out


def row_key() -> Column:
    """row: the hash of doc_id and the whole text."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("bigint"), F.col("text")).alias("row")


def rows_of(docs: DataFrame, stay: DataFrame, most: int = BROADCAST) -> DataFrame:
    """One row of docs for each of stay (row, times: how often docs has it), with the columns of docs. Up to `most` of stay are broadcast."""
    stay = stay.select(F.col("row").alias("__row"), F.col("times").alias("__times"))
    kept = docs.withColumn("__row", row_key()).join(F.broadcast(stay) if stay.count() <= most else stay, "__row")
    return kept.filter("__times = 1").union(kept.filter("__times > 1").dropDuplicates(["__row"])).select(*docs.columns)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v), of one orderable type: (node, root), root the least node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each hangs a node's neighbours under
    its least neighbour, by a pre-aggregated minimum and a join, so a hub of any degree is split over tasks. Rounds
    grow with the logarithm of a component's diameter. Self-loops and nulls are ignored; no edges, no rows.
    """
    edges = cut(edges.select("u", "v").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("u").alias("own"))
        small = small.select("u", "v").union(small.select("own", "v")).filter("u <> v").distinct()
        before_edges, edges = edges, cut(small)
        forget(before_edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
