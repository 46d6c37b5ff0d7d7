"""One cycle from fetched pages to facts as a single job that measures itself: totals of each stage as the rows pass, counters by page, a manifest by batch.

A cycle takes in all pages that have come since the last one and ends. Its checkpoint knows what was taken, a lock keeps a second cycle out, and a batch
that is run again replaces what it had written, so a cycle that breaks off is simply started again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audits as U
from ..operators import extract as X
from ..operators import refine as R
from . import store as K


def sound(subject: Column, predicate: Column, object_: Column) -> Column:
    """Whether both spans may name entities."""
    return R.span_reason(subject, "subject").isNull() & R.span_reason(object_, "object", predicate=predicate).isNull()


def stages(pages: DataFrame, keep: Callable[[Column, Column, Column], Column] = sound) -> tuple[DataFrame, DataFrame]:
    """(counts, triples) of pages (page_id, url, status, html): by page the status, characters, sentences, raw triples, kept triples and their distinct
    facts; the kept triples as occurrences. A null status counts as 200; of other pages nothing is read."""
    ok = F.coalesce("status", F.lit(200)) == 200
    text = F.when(ok, T.strip_html(F.col("html"))).otherwise("")
    rows = pages.select("page_id", "url", F.coalesce("status", F.lit(200)).alias("status"), text.alias("text"))
    found = X.verb_triples(rows.select("page_id", "text"), id_col="page_id").withColumn("kept", keep(F.col("subject"), F.col("predicate"), F.col("object")))
    key = T.fact_key(F.col("subject"), F.col("predicate"), F.col("object"))
    per = found.groupBy("page_id").agg(F.count("*").alias("raw"), F.count_if("kept").alias("canonical"), F.count_distinct(F.when(F.col("kept"), key)).alias("facts"))
    sizes = rows.select("page_id", "url", "status", F.length("text").cast("bigint").alias("length"), F.size(T.sentences(F.col("text"))).cast("bigint").alias("sentences"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("raw", "canonical", "facts")}
    counts = sizes.join(per, "page_id", "left").withColumns(zero)
    triples = found.filter("kept").join(rows.select("page_id", "url"), "page_id")
    confidence = X.confidence(F.col("subject"), F.col("predicate"), F.col("object"))
    return counts, triples.select("subject", "predicate", "object", "url", T.domain_of(F.col("url")).alias("domain"), confidence.alias("confidence"), F.struct("page_id", "clause", "pos").alias("seq"))


def take(pages: DataFrame, n: int, store: str, keep: Callable[[Column, Column, Column], Column] = sound) -> None:
    """Takes batch n in: counters, facts, and last its line of the manifest, so that a batch with a line is whole."""
    counts, triples = stages(pages, keep)
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sentences", "raw", "canonical", "facts")]
    passed = Observation(f"cycle-{n}")
    counts.observe(passed, F.count("*").alias("pages"), F.count_if(F.col("status") == 200).alias("fetched"), *totals).write.mode("overwrite").parquet(f"{store}/counts/batch={n}")
    K.apply(triples, n, f"{store}/facts", K.FACTS)
    # of no pages there is no plan that could observe any
    line = {"batch": n} | (dict.fromkeys(("pages", "fetched", "sentences", "raw", "canonical", "facts"), 0) if pages.isEmpty() else passed.get)
    names = ("batch", "pages", "fetched", "sentences", "raw", "canonical", "facts")
    pages.sparkSession.createDataFrame([tuple(line[c] for c in names)], ", ".join(f"{c} bigint" for c in names)).write.mode("overwrite").json(f"{store}/manifest/{n}")


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """A row for each whole batch: pages, fetched ones, sentences, raw and kept triples, facts of a page."""
    return spark.read.schema("batch bigint, pages bigint, fetched bigint, sentences bigint, raw bigint, canonical bigint, facts bigint").json(f"{store}/manifest/*")


def diagnosed(spark: SparkSession, store: str) -> DataFrame:
    """The counters of each page with the stage at which its extraction stopped; persisted: those of its facts that are in the store."""
    rows = spark.read.parquet(f"{store}/counts").drop("batch")
    held = K.current(spark, f"{store}/facts", K.FACTS).agg(F.count("*").alias("held"))
    return rows.join(F.broadcast(held)).withColumn("stage", U.diagnose(F.col("status"), F.col("length"), F.col("sentences"), F.col("raw"), F.col("canonical"), F.least("facts", "held"))).drop("held")


def run(pages: DataFrame, store: str, checkpoint: str, keep: Callable[[Column, Column, Column], Column] = sound) -> DataFrame:
    """A cycle over a stream of pages; the manifest after it. An error while another cycle holds the lock of the store."""
    spark = pages.sparkSession
    fs, lock = K._fs(spark, f"{store}/_lock")
    try:
        fs.create(lock, False).close()
    except Exception as e:
        raise PySparkException(f"another cycle holds {store}/_lock") from e
    try:
        query = pages.writeStream.foreachBatch(lambda batch, n: take(batch, n, store, keep)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        fs.delete(lock, False)
    return manifest(spark, store)
