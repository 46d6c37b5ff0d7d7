"""What arrived, what was new and what was lost: accounting of ingests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .graph import with_keys


def arrivals(occ: DataFrame, key: str = "fact_key") -> DataFrame:
    """occ with `class`: of each key in order of seq the first is new; then same_url, same_domain or cross_domain.

    All but the first of a key, url and domain are same_url. Only these firsts are ordered by url and by domain, and only the first of each domain by key
    alone (the others are spread by url), so no task holds all that arrived for a key.
    """

    def nth(*by: str | Column):
        return F.row_number().over(Window.partitionBy(*by).orderBy("seq"))

    ranked = occ.withColumn("__r", nth(key, "url", "domain"))
    rest = ranked.filter("__r > 1").drop("__r").withColumn("class", F.lit("same_url"))
    firsts = ranked.filter("__r = 1").drop("__r").withColumn("__u", nth(key, "url")).withColumn("__d", nth(key, "domain"))
    spread = F.when(F.col("__d") > 1, F.xxhash64("url", "domain"))
    new = (F.col("__d") == 1) & (nth(key, spread) == 1)
    kind = F.when(new, "new").when(F.col("__u") > 1, "same_url").when(F.col("__d") > 1, "same_domain").otherwise("cross_domain")
    return firsts.withColumn("class", kind).drop("__u", "__d").unionByName(rest)


def snapshot(classified: DataFrame, key: str = "fact_key") -> DataFrame:
    """One row: occurrences, distinct keys, each class, and what the classes leave unaccounted (0)."""
    n = [F.count_if(F.col("class") == c).alias(c) for c in ("new", "same_url", "same_domain", "cross_domain")]
    row = classified.agg(F.count("*").alias("occurrences"), F.count_distinct(key).alias("distinct_keys"), *n)
    return row.withColumn("unaccounted", F.col("occurrences") - F.col("new") - F.col("same_url") - F.col("same_domain") - F.col("cross_domain"))


def reconcile(raw: DataFrame, refined: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: raw triples, canonical ones, rejected ones, facts, and the gaps between the steps."""
    row = raw.agg(F.count("*").alias("raw_triples")).join(refined.agg(F.count_if(F.expr("reason = 'ok'")).alias("canonical"), F.count_if(F.expr("reason <> 'ok'")).alias("rejected"))).join(facts.agg(F.count("*").alias("persisted")))
    return row.withColumn("unaccounted", F.col("raw_triples") - F.col("canonical") - F.col("rejected")).withColumn("merged", F.col("canonical") - F.col("persisted"))


def domain_coverage(occ: DataFrame) -> DataFrame:
    """For each domain the facts that it alone confirms and those that others confirm too. A null domain is <unknown>."""
    pairs = with_keys(occ).select("fact_key", F.coalesce("domain", F.lit("<unknown>")).alias("domain")).distinct()
    n = pairs.groupBy("fact_key").agg(F.count("*").alias("n"))
    return pairs.join(n, "fact_key").groupBy("domain").agg(F.count("*").alias("facts"), F.count_if(F.expr("n = 1")).alias("alone"), F.count_if(F.expr("n > 1")).alias("shared"))


def duplicates(facts: DataFrame, top: int = 20) -> DataFrame:
    """Facts that are one after trimming and upper-casing; hidden_cross if their domains differ, else same_domain. The largest groups.

    facts: subject, predicate, object, domains (array).
    """
    key = F.concat_ws("|", *[F.upper(F.trim(c)) for c in ("subject", "predicate", "object")])
    groups = facts.withColumn("dup_key", key).groupBy("dup_key").agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("domains")))).alias("all_domains"), F.count_distinct("domains").alias("kinds"))
    groups = groups.filter("n > 1").withColumn("class", F.when(F.col("kinds") > 1, "hidden_cross").otherwise("same_domain")).drop("kinds")
    return groups.orderBy(F.desc("n"), "dup_key").limit(top)


def publisher_families(domain_counts: DataFrame, families: DataFrame) -> DataFrame:
    """Facts per publisher family (families: domain, family); domains of none are `unknown`, `independent` false for these."""
    out = domain_counts.join(families, "domain", "left").withColumn("family", F.coalesce("family", F.lit("unknown")))
    return out.groupBy("family").agg(F.sum("n").alias("n"), F.count("*").alias("domains")).withColumn("independent", F.col("family") != "unknown")


def family_snapshot(by_family: DataFrame) -> DataFrame:
    """One row: families, known ones, and warnings for families of several domains, in order."""
    many = F.when(F.col("independent") & (F.col("domains") > 1), F.concat(F.upper("family"), F.lit("_DOMAINS_NOT_INDEPENDENT")))
    return by_family.agg(F.count("*").alias("families"), F.count_if("independent").alias("effective"), F.array_join(F.array_sort(F.collect_list(many)), ",").alias("warnings"))


def reingest_baseline(occ: DataFrame) -> DataFrame:
    """One row on facts: confirmed twice, by two domains, by three, most domains, strictly verified (3 urls and 2 domains)."""
    per = with_keys(occ).groupBy("fact_key").agg(F.count_distinct("url").alias("urls"), F.count_distinct("domain").alias("domains"))
    return per.agg(F.count_if(F.expr("urls >= 2")).alias("urls_2"), F.count_if(F.expr("domains >= 2")).alias("domains_2"), F.count_if(F.expr("domains >= 3")).alias("domains_3"), F.max("domains").alias("most_domains"), F.count_if(F.expr("urls >= 3 and domains >= 2")).alias("strict"))


def verified_ratios(facts: DataFrame, by: str) -> DataFrame:
    """Verified facts and their ratio by a column."""
    return facts.groupBy(by).agg(F.count("*").alias("facts"), F.count_if("verified").alias("verified")).withColumn("ratio", F.round(F.col("verified") / F.col("facts"), 4))


def same_domain_urls(occ: DataFrame) -> DataFrame:
    """One row: facts with more urls than domains."""
    per = with_keys(occ).groupBy("fact_key").agg(F.count_distinct("url").alias("urls"), F.count_distinct("domain").alias("domains"))
    return per.agg(F.count_if(F.expr("urls > domains")).alias("multi_url_facts"))


def family_eligible(occ: DataFrame, families: DataFrame, least_domains: int = 3, least_families: int = 2) -> DataFrame:
    """Facts with their numbers of domains and publisher families; eligible with enough of both."""
    per = with_keys(occ).join(families, "domain", "left").groupBy("fact_key").agg(F.count_distinct("domain").alias("domains"), F.count_distinct("family").alias("families"))
    return per.withColumn("eligible", (F.col("domains") >= least_domains) & (F.col("families") >= least_families))


def triangulate(occ: DataFrame, least: int = 3, threshold: float = 0.6) -> DataFrame:
    """Facts verified by domains and mean confidence, else hypotheses."""
    per = with_keys(occ).groupBy("fact_key").agg(F.count_distinct("domain").alias("domains"), F.round(F.avg(F.round("confidence", 6).cast("decimal(10,6)")).cast("double"), 6).alias("mean_confidence"))
    return per.withColumn("status", F.when((F.col("domains") >= least) & (F.col("mean_confidence") >= threshold), "VERIFIED").otherwise("QUARANTINE"))


def collisions(occ: DataFrame, required: int = 3) -> DataFrame:
    """Per (object, predicate): how many domains tell of it; full, partial or none of the required number."""
    per = occ.groupBy("object", "predicate").agg(F.count_distinct("domain").alias("domains"), F.count("*").alias("hits"), F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domain_list"))
    return per.withColumn("collision", F.when(F.col("domains") >= required, "full").when(F.col("domains") > 1, "partial").otherwise("none"))


def required_domains(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected facts (fact_key, required array, quorum) against observed (fact_key, domains array): missing domains and a class."""
    out = expected.join(observed, "fact_key", "left")
    have = F.coalesce("domains", F.array().cast("array<string>"))
    lack = F.array_sort(F.array_except("required", have))
    kind = F.when(F.col("domains").isNull(), "missing").when((F.size(lack) == 0) & (F.size(have) >= F.col("quorum")), "verified").otherwise("partial")
    return out.select("fact_key", F.size(have).alias("observed"), F.array_join(lack, ",").alias("lacking"), kind.alias("class"))


def hosts(pages: DataFrame) -> DataFrame:
    """Pages by domain and base domain."""
    rows = pages.withColumn("domain", T.domain_of(F.col("url")))
    return rows.groupBy("domain").agg(F.count("*").alias("pages")).withColumn("base", T.base_domain(F.col("domain")))
