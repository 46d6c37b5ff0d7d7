"""Readers: episode and ingest logs, fact files, transcripts, feeds, graph dumps, and fetched pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPISODE = "timestamp double, kind string, content struct<source_url:string,extracted_entities:array<struct<subject:string,predicate:string,object:string,confidence:double>>>"


def episode_log(spark: SparkSession, path: str, last: int | None = None, ties: tuple[Column, ...] = ()) -> DataFrame:
    """Lines of JSON, malformed ones left out; the last ones by time if so asked, of equal times the first by `ties`."""
    rows = spark.read.schema(EPISODE).option("mode", "DROPMALFORMED").json(path)
    return rows if last is None else rows.orderBy(F.desc("timestamp"), *ties).limit(last)


def quarantine_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("timestamp double, reason string, score double, payload string").json(path)


def fact_file(spark: SparkSession, path: str) -> DataFrame:
    """Facts as lines of JSON, a list, or under `facts` or `items`."""
    one = "subject string, predicate string, object string, confirmations bigint, source_domains array<string>"
    text = spark.read.text(path, wholetext=True).select("value")
    whole = F.from_json("value", f"array<struct<{one}>>")
    inner = F.from_json("value", f"facts array<struct<{one}>>, items array<struct<{one}>>")
    lines = F.transform(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, one))
    starts = F.left(F.trim("value"), F.lit(1))
    rows = F.when(starts == "[", whole).otherwise(F.coalesce(inner["facts"], inner["items"], lines))
    return text.select(F.explode(rows).alias("f")).select("f.*").filter("subject is not null")


def worker_log(lines: DataFrame) -> DataFrame:
    """Lines (value, pos) of a log with `ingest url={...}` records: status and accepted triples per url, the last one wins."""
    row = lines.select("pos", F.regexp_extract("value", r"ingest (\S+?)=(\{.*\})", 1).alias("url"), F.regexp_extract("value", r"ingest (\S+?)=(\{.*\})", 2).alias("body")).filter("url <> ''")
    row = row.select("url", "pos", F.from_json("body", "status string, accepted bigint").alias("b"))
    return row.groupBy("url").agg(F.max_by("b", "pos").alias("b")).select("url", "b.status", "b.accepted")


def transcript(lines: DataFrame) -> DataFrame:
    """Lines (pos, value) of a WebVTT file as text: headers, times and numbers go, tags too, and a line that repeats the one before."""
    from pyspark.sql.window import Window

    x = F.trim(F.regexp_replace("value", "<[^>]+>", ""))
    rows = lines.select("file", "pos", x.alias("x")).filter((F.col("x") != "") & ~F.col("x").rlike(r"^(WEBVTT|Kind:|Language:|NOTE)|-->|^[0-9]+$"))
    before = F.lag("x").over(Window.partitionBy("file").orderBy("pos"))
    rows = rows.withColumn("b", before).filter(~F.col("x").eqNullSafe(F.col("b")))
    return rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]), " ").alias("text"))


def feed(xml: DataFrame, most: int = 20) -> DataFrame:
    """(url, title, link) of the first items of RSS documents (url, xml)."""
    zipped = F.arrays_zip(F.xpath("xml", F.lit("//item/title/text()")).alias("title"), F.xpath("xml", F.lit("//item/link/text()")).alias("link"))
    return xml.select("url", F.explode(F.slice(zipped, 1, most)).alias("i")).select("url", "i.title", "i.link")


def pages(spark: SparkSession, path: str, least: int = 200) -> DataFrame:
    """Fetched pages (url, html, status) as payloads: those of status 200 and enough text. A null status, as of pages that were never fetched over HTTP, counts as 200."""
    from ..functions import text as T

    rows = spark.read.parquet(path).filter(F.coalesce("status", F.lit(200)) == 200)
    out = rows.select("url", T.domain_of(F.col("url")).alias("domain"), T.html_title(F.col("html")).alias("title"), T.strip_html(F.col("html")).alias("content"))
    return out.filter(F.length("content") >= least)


def write_dump(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two tables, edges by type."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def read_dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def quarantine_split(rows: DataFrame, approve: list[int]) -> tuple[DataFrame, DataFrame]:
    """(approved, remaining) of quarantined rows by position."""
    hit = F.col("pos").isin(*approve) if approve else F.lit(False)
    return rows.filter(hit), rows.filter(~hit)


def write_sft(records: DataFrame, path: str) -> None:
    """Instruction records as lines of JSON beside their description."""
    records.write.mode("overwrite").json(f"{path}/data")
    info = records.sparkSession.createDataFrame([("data", "instruction", "input", "output")], "file_name string, prompt string, query string, response string")
    info.write.mode("overwrite").json(f"{path}/dataset_info")


def write_reports(rows: DataFrame, path: str, name: str) -> None:
    """Each row as a JSON document, in a folder by the value of `name`; nulls are written, so every document has all keys."""
    document = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    rows.select(F.col(name).alias("report"), document.alias("value")).write.partitionBy("report").text(path)


def read_reports(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", schema).alias("j")).select("j.*")
