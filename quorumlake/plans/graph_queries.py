"""Queries on facts, relations, accounting and diversity, over line items as occurrences of triples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import accounting as A
from ..operators import graph as G
from .bindings import FACTS, FAMILIES, OCC, families, occurrences
from .registry import query


@query("a01_quorum_verification", FACTS + " SELECT fact_key, fact_hash, occurrences, domains, urls, verified FROM facts")
def _(t):
    return G.facts(occurrences(t)).select("fact_key", "fact_hash", "occurrences", "domains", "urls", "verified")


@query("k01_ingest_facts", OCC + " SELECT fact_key, arg_min(subject, seq) AS subject, arg_min(predicate, seq) AS predicate, arg_min(object, seq) AS object, count(DISTINCT domain) >= 3 AS verified FROM occ GROUP BY fact_key")
def _(t):
    return G.facts(occurrences(t)).select("fact_key", "subject", "predicate", "object", "verified")


@query("w06_relations_last_write", OCC + " SELECT subject, predicate, object, arg_max(confidence, seq) AS confidence, arg_max(url, seq) AS url, count(*) AS occurrences FROM occ GROUP BY 1, 2, 3")
def _(t):
    return G.relations(occurrences(t))


@query("w05_first_and_last_writers", OCC + " SELECT url, arg_max(domain, seq) AS domain, arg_min(subject, seq) AS first_subject, arg_max(subject, seq) AS last_subject FROM occ GROUP BY url")
def _(t):
    occ = occurrences(t)
    ends = occ.groupBy("url").agg(F.min_by("subject", "seq").alias("first_subject"), F.max_by("subject", "seq").alias("last_subject"))
    return G.sources(occ).select("url", "domain").join(ends, "url")


@query("k01_confirmations", OCC + " SELECT DISTINCT url, fact_key FROM occ")
def _(t):
    return G.confirmations(occurrences(t))


@query("k01_mined_from", OCC + " SELECT DISTINCT unnest([subject, object]) AS concept, url FROM occ")
def _(t):
    return G.mined_from(occurrences(t))


@query("j04_incremental_recount", FACTS + " SELECT fact_key, occurrences, domains, verified FROM facts")
def _(t):
    occ = occurrences(t)
    late = F.col("predicate") == "AF"
    old = G.facts(occ.filter(~late))
    return G.recount(old, occ, occ.filter(late)).select("fact_key", "occurrences", "domains", "verified")


@query(
    "a02_counts",
    FACTS
    + """ SELECT (SELECT count(DISTINCT c) FROM (SELECT subject c FROM occ UNION ALL SELECT object FROM occ)) AS concepts, (SELECT count(DISTINCT url) FROM occ) AS sources,
  (SELECT count(*) FROM (SELECT DISTINCT subject, predicate, object FROM occ)) AS relations, count(*) AS facts, count(*) FILTER (verified) AS verified, CAST(sum(urls) AS BIGINT) AS confirmations FROM facts""",
)
def _(t):
    occ = occurrences(t)
    return G.counts(occ, G.facts(occ))


@query(
    "a03_graph_snapshot",
    FACTS
    + """ SELECT count(*) AS facts, count(*) FILTER (verified) AS verified, CAST(max(domains) AS BIGINT) AS most_domains, CAST(sum(occurrences) AS BIGINT) AS occurrences,
  count(DISTINCT predicate) AS predicates, count(*) FILTER (domains = 1) AS one_domain FROM facts""",
)
def _(t):
    return G.facts(occurrences(t)).agg(F.count("*").alias("facts"), F.count_if("verified").alias("verified"), F.max("domains").alias("most_domains"), F.sum("occurrences").alias("occurrences"), F.count_distinct("predicate").alias("predicates"), F.count_if(F.expr("domains = 1")).alias("one_domain"))


@query("a04_verified_domain_counts", FACTS + " SELECT domain, count(DISTINCT fact_key) AS facts FROM occ JOIN facts USING (fact_key) WHERE verified GROUP BY domain")
def _(t):
    occ = occurrences(t)
    return G.verified_domain_counts(occ, G.facts(occ))


_ACCOUNTED = """WITH f AS (SELECT CASE WHEN doc_id % 11 <> 0 THEN sha256(lang || '|' || (doc_id % 700)) END AS h FROM documents),
g AS (SELECT h, count(*) AS n FROM f GROUP BY h)
SELECT CAST(sum(n) AS BIGINT) AS persisted_facts, count(*) FILTER (h IS NOT NULL) AS distinct_non_null, CAST(coalesce(sum(n) FILTER (h IS NULL), 0) AS BIGINT) AS missing,
  count(*) FILTER (h IS NOT NULL AND n > 1) AS duplicate_groups, CAST(count(*) FILTER (h IS NOT NULL) + coalesce(sum(n) FILTER (h IS NULL), 0) AS BIGINT) AS distinct_keys,
  CASE WHEN sum(n) = 0 THEN 'zero_facts' WHEN count(*) FILTER (h IS NOT NULL AND n > 1) > 0 THEN 'duplicate_fact_hashes' WHEN sum(n) FILTER (h IS NULL) > 0 THEN 'missing_fact_hashes' ELSE 'ok' END AS status,
  CAST(count(*) FILTER (h IS NOT NULL) + coalesce(sum(n) FILTER (h IS NULL), 0) - sum(n) AS BIGINT) AS gap FROM g"""


@query("a05_fact_accounting", _ACCOUNTED)
def _(t):
    h = F.when(F.col("doc_id") % 11 != 0, F.sha2(F.concat_ws("|", "lang", F.col("doc_id") % 700), 256))
    return G.accounting(t("documents").select(h.alias("fact_hash")))


@query(
    "a07_concept_degrees",
    OCC
    + """ SELECT name, coalesce(n, 0) AS out_degree FROM (SELECT DISTINCT unnest([subject, object]) AS name FROM occ)
  LEFT JOIN (SELECT subject AS name, count(*) AS n FROM (SELECT DISTINCT subject, predicate, object FROM occ) GROUP BY 1) USING (name) ORDER BY out_degree DESC, name LIMIT 25""",
)
def _(t):
    return G.degrees(occurrences(t))


@query("a08_contradictions", "WITH o AS (SELECT o_custkey AS subject, o_orderpriority AS object, o_orderstatus AS predicate FROM orders WHERE o_orderstatus IN ('F', 'P')) SELECT subject, object, 'F,P' AS predicates, count(*) AS occurrences FROM o GROUP BY 1, 2 HAVING count(DISTINCT predicate) = 2")
def _(t):
    occ = t("orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("object"), F.col("o_orderstatus").alias("predicate"))
    return G.contradictions(occ, "F", "P").withColumn("predicates", F.array_join("predicates", ","))


@query(
    "r13_resolve_contradictions",
    """WITH o AS (SELECT o_custkey AS subject, o_orderpriority AS object, o_orderstatus AS predicate, o_orderkey AS seq, o_totalprice AS confidence FROM orders WHERE o_orderstatus IN ('F', 'P')),
p AS (SELECT subject, object FROM o GROUP BY 1, 2 HAVING count(DISTINCT predicate) = 2 ORDER BY 1, 2 LIMIT 5)
SELECT subject, object, arg_min(predicate, row(-confidence, seq)) AS predicate, arg_min(seq, row(-confidence, seq)) AS url, max(confidence) AS confidence FROM o JOIN p USING (subject, object) GROUP BY 1, 2""",
)
def _(t):
    occ = t("orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("object"), F.col("o_orderstatus").alias("predicate"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("url"), F.col("o_totalprice").alias("confidence"))
    return G.resolve_contradictions(G.contradictions(occ, "F", "P"), occ, "F", "P")


@query(
    "t05_verified_export",
    FACTS
    + """ SELECT min(f.subject) AS subject, min(f.predicate) AS predicate, min(f.object) AS object, min(f.fact_hash) AS fact_hash, count(DISTINCT o.url) AS confirmations,
  string_agg(DISTINCT o.domain, ',' ORDER BY o.domain) AS source_domains FROM facts f JOIN occ o USING (fact_key) WHERE verified GROUP BY fact_key""",
)
def _(t):
    occ = occurrences(t)
    return G.verified_export(occ, G.facts(occ)).drop("source_urls").withColumn("source_domains", F.array_join("source_domains", ","))


@query("j02_edges_verified", FACTS + " SELECT DISTINCT o.subject, o.predicate, o.object, coalesce(f.verified, false) AS verified FROM occ o LEFT JOIN (SELECT * FROM facts WHERE domains > 5) f USING (fact_key)")
def _(t):
    occ = occurrences(t)
    return G.edges_verified(occ, G.facts(occ).filter("domains > 5"))


_LINKS = """, e AS (SELECT DISTINCT subject, predicate, object, f.verified FROM occ JOIN (SELECT fact_key, verified FROM facts) f USING (fact_key)),
l AS (SELECT * FROM e ORDER BY subject, predicate, object LIMIT 100)"""


@query("g20_topology_nodes", FACTS + _LINKS + """ SELECT id, CASE WHEN v THEN 2 ELSE 1 END AS "group", CASE WHEN v THEN 22 ELSE 14 END AS val, v AS verified FROM (SELECT id, bool_or(verified) AS v FROM (SELECT subject AS id, verified FROM l UNION ALL SELECT object, verified FROM l) GROUP BY id)""")
def _(t):
    occ = occurrences(t)
    return G.topology(G.edges_verified(occ, G.facts(occ)))[0]


@query("g20_topology_links", FACTS + _LINKS + " SELECT subject AS source, object AS target, predicate AS label, verified FROM l")
def _(t):
    occ = occurrences(t)
    return G.topology(G.edges_verified(occ, G.facts(occ)))[1]


_TRADE = "e AS (SELECT DISTINCT cn.n_name AS subject, sn.n_name AS object FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey)"


def trade(t):
    """Nations of customers and of suppliers that orders join."""
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    n = t("nation")
    o = o.join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("subject")), "c_nationkey").join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("object")), "s_nationkey")
    return o.select("subject", "object").distinct()


@query("j13_adjacency", f"WITH {_TRADE}, b AS (SELECT subject AS name, object AS neighbour FROM e UNION SELECT object, subject FROM e) SELECT name, string_agg(DISTINCT neighbour, ',' ORDER BY neighbour) AS neighbours FROM b WHERE name <> neighbour GROUP BY name")
def _(t):
    return G.adjacency(trade(t).select(F.col("subject").alias("source"), F.col("object").alias("target"))).withColumn("neighbours", F.array_join("neighbours", ","))


@query(
    "j07_two_hop_paths",
    f"""WITH {_TRADE}, x AS (SELECT subject || '>' || object AS id, subject AS a, object AS b FROM e UNION ALL SELECT subject || '>' || object, object, subject FROM e),
one AS (SELECT id, b FROM x WHERE a = 'NATION_3')
SELECT DISTINCT 'NATION_3' AS origin, relations, target FROM (SELECT 'trades' AS relations, b AS target FROM one UNION ALL SELECT 'trades>trades', x.b FROM one JOIN x ON x.a = one.b WHERE x.id <> one.id)""",
)
def _(t):
    edges = trade(t).select(F.concat_ws(">", "subject", "object").alias("id"), "subject", F.lit("trades").alias("predicate"), "object")
    return G.paths(edges, "NATION_3").withColumn("relations", F.array_join("relations", ">"))


_MEMBERS = "e AS (SELECT DISTINCT 'u' || user_id AS a, 'k' || json_extract_string(props, '$.k') || '/' || (user_id % 9) AS b FROM events WHERE event_type = 'purchase')"


@query("g05_components", f"WITH RECURSIVE {_MEMBERS}, x AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, seen) AS (SELECT a, a FROM x UNION SELECT r.node, x.b FROM r JOIN x ON x.a = r.seen) SELECT node, min(seen) AS root FROM r GROUP BY node")
def _(t):
    e = t("events").filter("event_type = 'purchase'").select(F.concat(F.lit("u"), "user_id").alias("a"), F.concat(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("/"), F.col("user_id") % 9).alias("b"))
    return G.components(e)


@query("r01_search_context", FACTS + " SELECT DISTINCT subject, predicate, object, verified FROM facts WHERE contains(lower(subject), 'brand#1') OR contains(lower(object), 'promo') ORDER BY subject, predicate, object LIMIT 8")
def _(t):
    occ = occurrences(t)
    words = t.spark.createDataFrame([("brand#1",), ("PROMO",)], "keyword string")
    return G.search_context(G.edges_verified(occ, G.facts(occ)), words)


@query("w04_arrival_classes", OCC + """, k AS (SELECT *, row_number() OVER (PARTITION BY fact_key ORDER BY seq) AS a, row_number() OVER (PARTITION BY fact_key, url ORDER BY seq) AS b, row_number() OVER (PARTITION BY fact_key, domain ORDER BY seq) AS c FROM occ)
 SELECT fact_key, url, CASE WHEN a = 1 THEN 'new' WHEN b > 1 THEN 'same_url' WHEN c > 1 THEN 'same_domain' ELSE 'cross_domain' END AS class, count(*) AS n FROM k GROUP BY 1, 2, 3""")
def _(t):
    return A.arrivals(G.with_keys(occurrences(t))).groupBy("fact_key", "url", "class").agg(F.count("*").alias("n"))


@query("a12_ingest_accounting", OCC + """, k AS (SELECT *, row_number() OVER (PARTITION BY fact_key ORDER BY seq) AS a, row_number() OVER (PARTITION BY fact_key, url ORDER BY seq) AS b, row_number() OVER (PARTITION BY fact_key, domain ORDER BY seq) AS c FROM occ)
 SELECT count(*) AS occurrences, count(DISTINCT fact_key) AS distinct_keys, count(*) FILTER (a = 1) AS "new", count(*) FILTER (a > 1 AND b > 1) AS same_url, count(*) FILTER (a > 1 AND b = 1 AND c > 1) AS same_domain, count(*) FILTER (a > 1 AND b = 1 AND c = 1) AS cross_domain, 0::BIGINT AS unaccounted FROM k""")
def _(t):
    return A.snapshot(A.arrivals(G.with_keys(occurrences(t))))


@query("a14_domain_coverage", OCC + ", p AS (SELECT DISTINCT fact_key, domain FROM occ), n AS (SELECT fact_key, count(*) AS n FROM p GROUP BY 1) SELECT domain, count(*) AS facts, count(*) FILTER (n = 1) AS alone, count(*) FILTER (n > 1) AS shared FROM p JOIN n USING (fact_key) GROUP BY domain")
def _(t):
    return A.domain_coverage(occurrences(t))


@query(
    "a21_duplicate_facts",
    """WITH f AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE ' ' || upper(p_name) END AS s, p_brand AS p, p_type AS o, 'd' || (p_size % 5) AS d FROM part)
SELECT upper(trim(s)) || '|' || upper(trim(p)) || '|' || upper(trim(o)) AS dup_key, count(*) AS n, string_agg(DISTINCT d, ',' ORDER BY d) AS all_domains, CASE WHEN count(DISTINCT d) > 1 THEN 'hidden_cross' ELSE 'same_domain' END AS class
FROM f GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, dup_key LIMIT 20""",
)
def _(t):
    s = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit(" "), F.upper("p_name")))
    rows = t("part").select(s.alias("subject"), F.col("p_brand").alias("predicate"), F.col("p_type").alias("object"), F.array(F.concat(F.lit("d"), F.col("p_size") % 5)).alias("domains"))
    return A.duplicates(rows).withColumn("all_domains", F.array_join("all_domains", ","))


@query("a17_publisher_families", FACTS + f", {FAMILIES}, d AS (SELECT domain, count(DISTINCT fact_key) AS n FROM occ JOIN facts USING (fact_key) WHERE verified GROUP BY 1) SELECT coalesce(family, 'unknown') AS family, CAST(sum(n) AS BIGINT) AS n, count(*) AS domains, coalesce(family, 'unknown') <> 'unknown' AS independent FROM d LEFT JOIN fam USING (domain) GROUP BY 1, 4")
def _(t):
    occ = occurrences(t)
    return A.publisher_families(G.verified_domain_counts(occ, G.facts(occ)).withColumnRenamed("facts", "n"), families(t))


@query("a17_family_snapshot", f"WITH {FAMILIES}, d AS (SELECT n_name AS domain FROM nation), f AS (SELECT coalesce(family, 'unknown') AS family, count(*) AS domains FROM d LEFT JOIN fam USING (domain) GROUP BY 1) SELECT count(*) AS families, count(*) FILTER (family <> 'unknown') AS effective, string_agg(CASE WHEN family <> 'unknown' AND domains > 1 THEN upper(family) || '_DOMAINS_NOT_INDEPENDENT' END, ',' ORDER BY family) AS warnings FROM f")
def _(t):
    return A.family_snapshot(A.publisher_families(t("nation").select(F.col("n_name").alias("domain"), F.lit(1).alias("n")), families(t)))


@query("a18_triangulation", OCC + " SELECT fact_key, count(DISTINCT domain) AS domains, round(avg(CAST(round(confidence, 6) AS DECIMAL(10, 6))), 6) AS mean_confidence, CASE WHEN count(DISTINCT domain) >= 20 AND round(avg(CAST(round(confidence, 6) AS DECIMAL(10, 6))), 6) >= 0.95005 THEN 'VERIFIED' ELSE 'QUARANTINE' END AS status FROM occ GROUP BY fact_key")
def _(t):
    return A.triangulate(occurrences(t), 20, 0.95005)


@query("a20_reingest_baseline", OCC + ", p AS (SELECT fact_key, count(DISTINCT url) AS u, count(DISTINCT domain) AS d FROM occ GROUP BY 1) SELECT count(*) FILTER (u >= 2) AS urls_2, count(*) FILTER (d >= 2) AS domains_2, count(*) FILTER (d >= 3) AS domains_3, max(d) AS most_domains, count(*) FILTER (u >= 3 AND d >= 2) AS strict FROM p")
def _(t):
    return A.reingest_baseline(occurrences(t))


@query("a24_verified_ratios", FACTS + " SELECT object, count(*) AS facts, count(*) FILTER (domains >= 20) AS verified, round(count(*) FILTER (domains >= 20) / count(*), 4) AS ratio FROM facts GROUP BY object")
def _(t):
    return A.verified_ratios(G.facts(occurrences(t), 20), "object")


@query("a45_same_domain_urls", OCC + " SELECT count(*) AS multi_url_facts FROM (SELECT fact_key FROM occ GROUP BY 1 HAVING count(DISTINCT url) > count(DISTINCT domain))")
def _(t):
    return A.same_domain_urls(occurrences(t))


@query("a46_collision_atlas", OCC + " SELECT object, predicate, count(DISTINCT domain) AS domains, count(*) AS hits, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domain_list, CASE WHEN count(DISTINCT domain) >= 24 THEN 'full' WHEN count(DISTINCT domain) > 1 THEN 'partial' ELSE 'none' END AS collision FROM occ GROUP BY 1, 2")
def _(t):
    return A.collisions(occurrences(t), 24)


@query("a47_family_eligible", OCC + f", {FAMILIES} SELECT fact_key, count(DISTINCT domain) AS domains, count(DISTINCT family) AS families, count(DISTINCT domain) >= 3 AND count(DISTINCT family) >= 2 AS eligible FROM occ LEFT JOIN fam USING (domain) GROUP BY 1")
def _(t):
    return A.family_eligible(occurrences(t), families(t))


@query("a29_required_domains", OCC + """, obs AS (SELECT fact_key, list(DISTINCT domain) AS ds FROM occ WHERE confidence < 0.91 GROUP BY 1), ex AS (SELECT DISTINCT fact_key, ['NATION_1', 'NATION_2'] AS req FROM occ)
 SELECT fact_key, coalesce(len(ds), 0)::INT AS observed, array_to_string(list_sort(list_filter(req, lambda x: NOT list_contains(coalesce(ds, []), x))), ',') AS lacking,
 CASE WHEN ds IS NULL THEN 'missing' WHEN list_contains(ds, 'NATION_1') AND list_contains(ds, 'NATION_2') AND len(ds) >= 3 THEN 'verified' ELSE 'partial' END AS class FROM ex LEFT JOIN obs USING (fact_key)""")
def _(t):
    occ = G.with_keys(occurrences(t))
    seen = occ.filter("confidence < 0.91").groupBy("fact_key").agg(F.collect_set("domain").alias("domains"))
    wanted = occ.select("fact_key").distinct().select("fact_key", F.array(F.lit("NATION_1"), F.lit("NATION_2")).alias("required"), F.lit(3).alias("quorum"))
    return A.required_domains(seen, wanted)


@query("j03_facts_by_domain", OCC + " SELECT coalesce(domain, '<unknown>') AS domain, count(DISTINCT fact_key) AS facts FROM (SELECT CASE WHEN domain <> 'NATION_4' THEN domain END AS domain, fact_key FROM occ) GROUP BY 1")
def _(t):
    occ = G.with_keys(occurrences(t)).select(F.when(F.col("domain") != "NATION_4", F.col("domain")).alias("domain"), "fact_key")
    return occ.groupBy(F.coalesce("domain", F.lit("<unknown>")).alias("domain")).agg(F.count_distinct("fact_key").alias("facts"))


@query("c15_page_domains", "SELECT domain, count(*) AS pages, array_to_string(list_slice(string_split(domain, '.'), -2, -1), '.') AS base FROM (SELECT regexp_replace(regexp_extract(lower(url), '^(?:[a-z]+://)?(?:[^/@]*@)?([^/:?#]+)', 1), '^www[.]', '') AS domain FROM pages) GROUP BY 1")
def _(t):
    return A.hosts(t("pages"))


@query("k07_upsert_points", "SELECT label, max(vec_id) AS vec_id FROM embeddings GROUP BY label")
def _(t):
    return G.last_write(t("embeddings").select("label", "vec_id"), "label", "vec_id")


@query("u08_exported_equals_restored", FACTS + " SELECT 0::BIGINT AS lacking, 0::BIGINT AS added, count(*) AS facts FROM facts")
def _(t):
    occ = occurrences(t)
    whole, again = G.facts(occ).select("fact_key", "domains"), G.facts(occ.repartition(4)).select("fact_key", "domains")
    lost = whole.exceptAll(again).agg(F.count("*").alias("lacking"))
    return lost.join(again.exceptAll(whole).agg(F.count("*").alias("added"))).join(whole.agg(F.count("*").alias("facts")))


@query("c14_keys_and_hashes", "SELECT p_partkey, sha256(lower(trim(p_name) || '|' || trim(p_brand) || '|' || trim(p_type))) AS fact_hash, lower(p_name) || '|' || upper(p_brand) || '|' || lower(p_type) AS fact_key, substr(sha256(p_name || '|' || p_brand || '|' || p_type), 1, 16) AS sentence_hash, ('0x' || substr(sha256(p_name || ':' || p_size), 1, 8))::BIGINT % 100000000 AS point_id, substr(sha256(p_name), 1, 12) AS secret FROM part")
def _(t):
    s, p, o = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return t("part").select("p_partkey", T.fact_hash(s, p, o).alias("fact_hash"), T.fact_key(s, p, o).alias("fact_key"), T.sentence_hash(s, p, o).alias("sentence_hash"), T.point_id(s, F.col("p_size")).alias("point_id"), T.secret_fingerprint(s).alias("secret"))
