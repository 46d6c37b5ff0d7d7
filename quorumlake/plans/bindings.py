"""The given tables in the shapes that the operators take, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OCC = """WITH occ AS (
  SELECT p_brand AS subject, l_returnflag || l_linestatus AS predicate, p_type AS object, s_name AS url, n_name AS domain,
         1 - l_discount AS confidence, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq,
         lower(p_brand) || '|' || upper(l_returnflag || l_linestatus) || '|' || lower(p_type) AS fact_key
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
FACTS = (
    OCC
    + """, facts AS (
  SELECT fact_key, sha256(lower(trim(min(subject)) || '|' || trim(min(predicate)) || '|' || trim(min(object)))) AS fact_hash,
         min(subject) AS subject, min(predicate) AS predicate, min(object) AS object, count(*) AS occurrences,
         count(DISTINCT domain) AS domains, count(DISTINCT url) AS urls, count(DISTINCT domain) >= 3 AS verified
  FROM occ GROUP BY fact_key)"""
)


def occurrences(t) -> DataFrame:
    """Line items as triples: brand, flag and status, type; the supplier is the url, its nation the domain. seq orders arrivals."""
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return rows.select(
        F.col("p_brand").alias("subject"), F.concat("l_returnflag", "l_linestatus").alias("predicate"), F.col("p_type").alias("object"), F.col("s_name").alias("url"),
        F.col("n_name").alias("domain"), (1 - F.col("l_discount")).alias("confidence"), seq.alias("seq"),
    )


EPISODES = """WITH ev AS (
  SELECT event_id, 'user ' || (user_id % 40) AS subject, event_type AS predicate, 'k' || json_extract_string(props, '$.k') AS object,
         'd' || (user_id % 7) AS source_domain, ts FROM events),
episodes AS (
  SELECT sha256(lower(subject || '|' || predicate || '|' || object)) AS fact_hash, CAST(ts AS DATE) AS day, min(subject) AS subject, min(predicate) AS predicate,
         min(object) AS object, min(ts) AS created_at, max(ts) AS last_seen_at, count(*) AS replays, round(count(*) * 0.1::DOUBLE, 4) AS weight
  FROM ev GROUP BY 1, 2)"""


def episode_events(t) -> DataFrame:
    """Events as triples of user, event type and property k."""
    return t("events").select(
        "event_id", F.concat(F.lit("user "), F.col("user_id") % 40).alias("subject"), F.col("event_type").alias("predicate"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("object"), F.concat(F.lit("d"), F.col("user_id") % 7).alias("source_domain"), "ts",
    )


FAMILIES = "fam AS (SELECT n_name AS domain, r_name AS family FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')"


def families(t) -> DataFrame:
    """Nations (domains) by region (publisher family); those of one region have none."""
    return t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).filter("r_name <> 'ASIA'").select(F.col("n_name").alias("domain"), F.col("r_name").alias("family"))
