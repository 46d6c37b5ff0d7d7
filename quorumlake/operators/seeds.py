"""Seeds, request budgets and candidate selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def seed_urls(clusters: DataFrame) -> DataFrame:
    """(pos, url): distinct urls of clusters (cluster, sources array of url), in order of first appearance."""
    flat = clusters.select("cluster", F.posexplode("sources").alias("p", "url"))
    first = flat.groupBy("url").agg(F.min(F.struct("cluster", "p")).alias("at"))
    return first.select("url", F.col("at.cluster").alias("cluster"), F.col("at.p").alias("pos"))


def validate_clusters(rows: DataFrame, least_domains: int = 3, least_publishers: int = 2, forbidden: tuple[str, ...] = ()) -> DataFrame:
    """Clusters (rows: cluster, url, domain, publisher) with all their errors; an empty text if they are fine."""
    out = rows.groupBy("cluster").agg(
        F.count_distinct("domain").alias("domains"), F.count_distinct("publisher").alias("publishers"), F.count("*").alias("n"), F.count_distinct("url").alias("urls"),
        F.count_if(~F.col("url").startswith("https://")).alias("plain"), F.count_if(F.col("domain").isin(*forbidden) if forbidden else F.lit(False)).alias("bad"),
        F.count_if(T.domain_of(F.col("url")) != F.col("domain")).alias("mismatch"),
    )
    why = F.array(F.when(F.col("domains") < least_domains, "too_few_domains"), F.when(F.col("publishers") < least_publishers, "too_few_publishers"), F.when(F.col("plain") > 0, "not_https"), F.when(F.col("urls") < F.col("n"), "duplicate_url"), F.when(F.col("bad") > 0, "forbidden_domain"), F.when(F.col("mismatch") > 0, "domain_mismatch"))
    return out.select("cluster", "domains", "publishers", F.array_join(F.array_compact(why), ",").alias("errors"))


def manifest_health(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_distinct(c).alias(f"{c}s") for c in ("cluster", "url", "domain", "publisher")])


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Urls of two ordered lists (url, pos), those of the first before, each once."""
    both = first.select("url", F.struct(F.lit(0), "pos").alias("at")).union(second.select("url", F.struct(F.lit(1), "pos").alias("at")))
    out = both.groupBy("url").agg(F.min("at").alias("at"))
    return out.select("url", F.col("at").getField("col1").alias("list"), F.col("at.pos").alias("pos"))


def first_per(rows: DataFrame, key: str, order: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("__r", place).filter("__r = 1").drop("__r")


def budget(requests: DataFrame, total: int, each: int, key: str = "domain", order: str = "pos") -> DataFrame:
    """Requests within a budget: at most `each` of a key, then the first `total` of these."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return requests.withColumn("__r", place).filter(F.col("__r") <= each).drop("__r").orderBy(order).limit(total)


def select_pilot(candidates: DataFrame, eligible: Column, most: int = 10) -> DataFrame:
    """The eligible candidates of least risk."""
    return candidates.filter(eligible).orderBy("risk", "id").limit(most)


def candidate_reason(url: Column, blocked: tuple[str, ...]) -> Column:
    """Why a url is no candidate: not_https, blocked or section_page; null if it is one."""
    found = F.exists(F.array(*[F.lit(b) for b in blocked]), lambda b: F.contains(url, b))
    depth = F.size(F.filter(F.split(F.regexp_replace(url, "^[a-z]+://[^/]*", ""), "/"), lambda x: x != ""))
    return F.when(~url.startswith("https://"), "not_https").when(found, "blocked").when(depth < 2, "section_page")


def batches(rows: DataFrame, order: str, size: int = 50) -> DataFrame:
    """rows with the number of their batch. The order is ranked by ranges of its values, each in a task of its own."""
    parts = rows.withColumn("__p", F.floor(F.col(order) / 10_000))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("__p").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy("__p").orderBy(order))
    return parts.withColumn("__own", own).join(sums, "__p").withColumn("batch", F.ceil((F.col("__before") + F.col("__own")) / size)).drop("__p", "__own", "__before")
