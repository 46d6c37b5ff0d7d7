"""Queries on records of fixed layouts, expected facts, clean-up of values, and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import records as R
from ..operators import refine as Q
from ..operators.extract import table_rows
from ..sources import readers as IO
from .bindings import FACTS, OCC, occurrences
from .registry import query
from .term_queries import _folder


@query("g08_season_honours", """WITH l AS (SELECT page_id, 1950 + page_id % 40 AS y, page_id % 7 AS k FROM pages)
SELECT competition, year, reason, count(*) AS n FROM (
SELECT CASE WHEN k IN (0, 5) THEN 'Copa ' || y END AS competition, CASE WHEN k IN (0, 5) THEN y + d END AS year, ['ok', 'runner_up', 'range', 'section', 'not_honours', 'ok', 'navigation'][k + 1] AS reason FROM l, (VALUES (0), (3)) v(d) WHERE k = 0 OR d = 0
UNION ALL SELECT NULL, NULL, ['no_years', 'no_years', 'no_years', 'no_years', 'not_honours', 'no_title', 'navigation'][k + 1] FROM l) GROUP BY 1, 2, 3""")
def _(t):
    k, y = F.col("page_id") % 7, F.col("page_id") % 40 + 1950

    def row(*cells):
        return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))

    name = F.concat(F.lit("Copa "), y.cast("string"))
    years = F.concat(y.cast("string"), F.lit(", "), (y + 3).cast("string"))
    body = (
        F.when(k == 0, row(F.concat(name, F.lit("[2]")), F.lit("2"), years))
        .when(k == 1, row(name, F.lit("Vice"), years))
        .when(k == 2, row(name, F.lit("9"), F.concat(y.cast("string"), F.lit("–"), (y + 3).cast("string"))))
        .when(k == 3, row(F.lit("National"), F.lit("3"), years))
        .when(k == 5, row(name, F.lit("4"), F.concat(F.lit("Campeão ("), y.cast("string"), F.lit(")"))))
        .otherwise(row(name, F.lit("1"), years))
    )
    css = F.when(k == 6, "navbox plain").otherwise("wikitable")
    head = F.when(k == 4, row(F.lit("Nome"), F.lit("n"), F.lit("anos"))).when(k == 5, row(F.lit("Competição"), F.lit("Part."), F.lit("Melhor campanha"))).otherwise(row(F.lit("Competição"), F.lit("Títulos"), F.lit("Temporadas")))
    html = F.concat("html", F.lit('<table class="'), css, F.lit('">'), head, body, F.lit("</table>"))
    rows = table_rows(t("pages").select("page_id", html.alias("html")))
    return R.season_honours(rows).groupBy("competition", "year", "reason").agg(F.count("*").alias("n"))




@query("g10_player_clubs", "SELECT p_partkey AS page_id, upper(p_name) AS subject, 'DEFENDEU' AS predicate, upper(p_type) AS object, CASE WHEN contains(p_name, 'cold') THEN 'unknown_player' WHEN p_type = 'SMALL' THEN 'unknown_club' ELSE 'ok' END AS reason FROM part")
def _(t):
    p = t("part")
    line = F.concat(F.lit("<p>no club (12 gols)</p><pre>\n  "), "p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit(" jogos de 1950 a 1961 como <b>jogador</b> do "), "p_type", F.lit(")\nalguém (3 gols)</pre>"))
    players = p.filter(~F.contains("p_name", F.lit("cold"))).select(F.col("p_name").alias("name")).distinct()
    clubs = p.filter("p_type <> 'SMALL'").select(F.col("p_type").alias("name")).distinct()
    return R.player_clubs(p.select(F.col("p_partkey").alias("page_id"), line.alias("html")), players, clubs).drop("pos")


@query("g12_told_places", "WITH s AS (SELECT s_suppkey, s_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT s_suppkey AS page_id, 'GROUND ' || (s_suppkey % 30) AS subject, 'LOCALIZADO_EM' AS predicate, 'Cidade ' || chr(97 + s_nationkey) || 'a' AS object FROM s WHERE s_suppkey % 5 <> 0")
def _(t):
    s = t("supplier").select(F.col("s_suppkey").alias("page_id"), (F.col("s_suppkey") % 30).cast("string").alias("k"), F.concat(F.lit("Cidade "), F.char(F.col("s_nationkey") + 97), F.lit("a")).alias("city"))
    two = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit(" beside estádio n"), ((F.col("k") + 1) % 30).cast("int").cast("string"), F.lit("x"))).otherwise("")
    html = F.concat(F.lit("<p>The Estádio N"), "k", F.lit("x"), two, F.lit(" is located in nowhere, mas localizado em <i>"), "city", F.lit("</i>, where it stands.</p>"))
    stadiums = s.select(F.concat(F.lit("estadio n"), "k", F.lit("x")).alias("alias"), F.concat(F.lit("GROUND "), "k").alias("stadium")).distinct()
    return R.told_places(s.select("page_id", html.alias("html")), stadiums, s.select("city").distinct())


@query("c22_domain_verbs", "WITH w AS (SELECT DISTINCT event_id, unnest(string_split(lower(event_type), '_')) AS w FROM events) SELECT verb, count(*) AS n FROM (SELECT CASE w WHEN 'purchase' THEN 'conquistou' WHEN 'click' THEN 'played' END AS verb FROM w) WHERE verb IS NOT NULL GROUP BY 1")
def _(t):
    text = F.concat(F.lit("Ele que "), F.when(F.col("event_type") == "purchase", "Conquistou!").when(F.col("event_type") == "click", "PLAYED; played").otherwise("desconquistou"), F.lit(" e foi"))
    return t("events").select(F.explode(R.domain_verbs(text)).alias("verb")).groupBy("verb").agg(F.count("*").alias("n"))


@query("s08_item_payloads", "SELECT p_brand AS item, 'Títulos: ' || upper(p_brand) AS title, count(*) AS n, min(upper(p_name)) AS first, max(upper(p_name)) AS last FROM part GROUP BY 1")
def _(t):
    b = t("part").select(F.concat(F.lit("http://items.example/entity/"), "p_brand").alias("item"), F.concat(F.lit(" "), "p_brand").alias("label"), F.col("p_name").alias("value"))
    b = b.unionByName(b.withColumn("value", F.upper(F.trim("label")))).unionByName(b.withColumn("value", F.lit(None).cast("string")))
    out = R.item_payloads(b, "VENCEU", "Títulos")
    return out.select("item", "title", "n", F.element_at("entities", 1)["object"].alias("first"), F.element_at("entities", -1)["object"].alias("last"))


@query("s07_json_answers", "SELECT CASE event_id % 6 WHEN 0 THEN 'host' WHEN 1 THEN 'format' WHEN 2 THEN 'content_type' WHEN 3 THEN 'size' ELSE 'ok' END AS reason, count(*) AS n, sum(CASE event_id % 6 WHEN 4 THEN 2 WHEN 5 THEN 1 ELSE 0 END)::BIGINT AS records FROM events GROUP BY 1")
def _(t):
    k = F.col("event_id") % 6
    url = F.when(k == 0, "http://maps.example.org/search?format=json").when(k == 1, "https://maps.example.org/search?format=xml").otherwise("https://maps.example.org/search?q=a&format=jsonv2")
    body = F.when(k == 3, F.repeat(F.lit("x"), F.lit(600))).when(k == 4, F.concat(F.lit("["), "props", F.lit(", {}]"))).otherwise(F.col("props"))
    rows = t("events").select(url.alias("url"), F.when(k == 2, "text/html").otherwise("application/json; charset=utf-8").alias("content_type"), body.alias("body"))
    return R.json_answers(rows, "maps.example.org", 500).groupBy("reason").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("records"), F.lit(0))).alias("records"))


@query("s20_marked_logs", "SELECT conv_id, turn, sha256('Resposta: ' || text) AS digest FROM conversations WHERE text IS NOT NULL")
def _(t):
    said = F.concat(F.lit("Resposta: "), "text")
    plain = said.rlike(r"^[\x00-\xFF]*$")
    raw = F.when(F.col("turn") % 3 == 0, F.encode(said, "UTF-16")).when((F.col("turn") % 3 == 1) & plain, F.encode(said, "ISO-8859-1")).otherwise(F.encode(F.concat(F.lit("﻿"), said), "UTF-8"))
    return t("conversations").filter("text is not null").select("conv_id", "turn", F.sha2(R.decode_by_marker(raw, ("Resposta", "telemetria", "partial_success")), 256).alias("digest"))


_PILOT = FACTS + """, r AS (SELECT f.subject, f.object, f.verified AND f.predicate = 'AF' AS verified, o.domain FROM facts f JOIN (SELECT DISTINCT fact_key, domain FROM occ) o USING (fact_key)),
e AS (SELECT DISTINCT p_brand AS s, p_type AS o FROM part UNION SELECT DISTINCT p_brand, 'UNKNOWN' FROM part),
d AS (SELECT s || '/' || o AS candidate_id, count(domain) > 0 AS present, coalesce(bool_or(verified), false) AS verified, list_distinct(coalesce(CASE WHEN bool_or(verified) THEN list(domain) FILTER (verified) ELSE list(domain) FILTER (domain IS NOT NULL) END, [])) AS ds FROM e LEFT JOIN r ON r.subject = e.s AND r.object = e.o GROUP BY s, o)
SELECT candidate_id, present, verified, len(ds)::INT AS domain_count, len(list_filter(ds, lambda x: x NOT IN ('NATION_0', 'NATION_1'))) > 0 AS outside, len(ds) >= 3 AS meets_quorum, CASE WHEN verified THEN 'verified' WHEN present THEN 'partial' ELSE 'missing' END AS status FROM d"""


def _expected(t):
    pairs = t("part").select("p_brand", "p_type").union(t("part").select("p_brand", F.lit("UNKNOWN"))).distinct()
    return pairs.select(F.concat_ws("/", "p_brand", "p_type").alias("candidate_id"), F.array(F.lower("p_brand"), "p_brand").alias("subjects"), F.array(F.concat(F.lit("the "), F.lower("p_type")), "p_type").alias("objects"))


def _confirmed(t):
    occ = G.with_keys(occurrences(t))
    facts = G.facts(occurrences(t)).select("fact_key", "verified")
    return occ.select("fact_key", "subject", "predicate", "object", "domain").distinct().join(facts, "fact_key")


@query("a50_pilot_validation", _PILOT)
def _(t):
    rows = _confirmed(t).select("subject", "object", (F.col("verified") & (F.col("predicate") == "AF")).alias("verified"), "domain")
    return R.pilot_validation(_expected(t), rows, ("NATION_0", "NATION_1"))


@query("a40_fact_states", FACTS + """, r AS (SELECT f.fact_key, f.subject, f.predicate, CASE f.object WHEN 'SMALL' THEN 'BAIRRO SMALL' WHEN 'LARGE' THEN 'LARGE' WHEN 'PROMO' THEN 'PROMO club of old' ELSE f.object || ' club' END AS object, f.object AS o, f.verified, d.domain FROM facts f JOIN (SELECT DISTINCT fact_key, domain FROM occ) d USING (fact_key)),
e AS (SELECT DISTINCT p_brand AS s, p_type AS o FROM part), x AS (SELECT e.s, e.o, r.*, coalesce(r.predicate = 'RF' AND r.o = e.o, false) AS exact FROM e LEFT JOIN r ON r.subject = e.s)
SELECT s || '/' || o AS candidate_id, count(DISTINCT fact_key) FILTER (exact) AS facts, coalesce(bool_or(exact AND verified), false) AS verified, count(DISTINCT domain) FILTER (exact) AS domain_count, coalesce(bool_or(exact AND domain <> 'NATION_0'), false) AS outside,
       coalesce(bool_or(exact AND o = 'PROMO'), false) AS span_broken, coalesce(bool_or(exact AND o IN ('SMALL', 'LARGE')), false) AS junk_object, coalesce(bool_or(exact AND o = 'SMALL'), false) AS forbidden_object, coalesce(bool_or(predicate NOT IN ('RF', 'AF')), false) AS invalid_predicate, coalesce(bool_or(exact AND o IN ('PROMO', 'SMALL', 'LARGE')), false) AS blocked FROM x GROUP BY s, o""".replace("SELECT e.s, e.o, r.*, ", "SELECT e.s, e.o, r.fact_key, r.predicate, r.verified, r.domain, "))
def _(t):
    def named(o):
        return F.when(o == "SMALL", "BAIRRO SMALL").when(o == "LARGE", "LARGE").when(o == "PROMO", "PROMO club").otherwise(F.concat(o, F.lit(" club")))

    kind = F.col("object")
    rows = _confirmed(t).withColumn("object", F.when(kind == "PROMO", "PROMO club of old").otherwise(named(kind))).withColumnRenamed("fact_key", "fact_id")
    pairs = t("part").select("p_brand", "p_type").distinct()
    wanted = pairs.select(F.concat_ws("/", "p_brand", "p_type").alias("candidate_id"), F.array("p_brand").alias("subjects"), F.array(F.lower(named(F.col("p_type")))).alias("objects"))
    return R.fact_states(wanted, rows, "RF", ("RF", "AF"), ("NATION_0",))


@query("a52_dry_run", "WITH s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS risk, CASE p_partkey % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'stored' ELSE 'none' END AS strength FROM part) SELECT count(*) AS selected, count(*) FILTER (risk = 'low') AS low_risk, count(*) FILTER (risk = 'medium') AS medium_risk, count(*) FILTER (risk = 'high') AS high_risk, count(*) FILTER (strength = 'read') AS evidence_read, count(*) FILTER (strength = 'stored') AS evidence_stored, count(*) FILTER (strength = 'none') AS evidence_none, count(*) FILTER (p_partkey % 5 = 0) AS warned, count(*) + 14 AS predicted_records, false AS ready FROM s")
def _(t):
    k = F.col("p_partkey")
    chosen = t("part").select(k.alias("candidate_id"), F.when(k % 3 == 0, "low").when(k % 3 == 1, "medium").otherwise("high").alias("risk"), F.array(F.when(k % 5 == 0, "www.tables.example").otherwise("a.example")).alias("required_domains"), F.lit(None).cast("array<string>").alias("risks"))
    evidence = t("part").filter(k % 4 < 2).select(k.alias("candidate_id"), F.when(k % 4 == 0, "read").otherwise("stored").alias("strength"))
    return R.dry_run(R.risk_matrix(chosen, evidence, "tables"), 6, 10, 14)


@query("c05_pair_aliases", "SELECT CASE WHEN p_type = 'PROMO' THEN 'DEFENDEU' ELSE 'DISPUTOU' END AS predicate, count(*) AS n FROM part GROUP BY 1")
def _(t):
    p = t("part").select(F.upper(T.fold_key(F.col("p_brand"))).alias("s"), F.col("p_brand").alias("subject"), F.lit("DISPUTOU").alias("predicate"), F.concat(F.lit("clube "), "p_type").alias("object"), F.lit(0.9).alias("confidence"))
    aliases = Q.alias_table(t("part").select(F.upper(T.fold_key(F.col("p_brand"))).alias("canonical"), F.col("p_brand").alias("variant")).distinct())
    pairs = p.filter("object = 'clube PROMO'").select(F.col("s").alias("subject"), F.upper(T.fold_key(F.col("object"))).alias("object"), F.lit("DISPUTOU").alias("old"), F.lit("DEFENDEU").alias("new")).distinct()
    return Q.refine(p.drop("s"), aliases, pairs).groupBy(F.col("c_predicate").alias("predicate")).agg(F.count("*").alias("n"))


@query("f16_confidence", "SELECT page_id, round(greatest(0, CASE WHEN regexp_matches(host, '\\.org|\\.edu|\\.gov|\\.ac\\.') THEN 0.9 ELSE 0.6 END - CASE WHEN page_id % 3 = 0 THEN 0.5 ELSE 0 END), 3)::DOUBLE AS confidence FROM (SELECT page_id, lower(regexp_extract(url, '://([^/:?#]+)', 1)) AS host FROM pages)")
def _(t):
    text = F.when(F.col("page_id") % 3 == 0, "Chocante: segredo revelado").otherwise("plain words of a page without any claim")
    return t("pages").select("page_id", Q.confidence(T.domain_of(F.col("url")), text).cast("double").alias("confidence"))


@query("c23_boundary_noise", "SELECT p_partkey, p_name AS bare FROM part")
def _(t):
    k = F.col("p_partkey") % 3
    said = F.concat(F.when(k == 0, "e que ").when(k == 1, "But ").otherwise(""), "p_name", F.when(k == 2, " foi").when(k == 1, " is").otherwise(""))
    return t("part").select("p_partkey", T.strip_connectives(said).alias("bare"))


@query("c30_secret_fingerprints", "SELECT p_partkey, substr(sha256(p_name), 1, 12) AS fingerprint FROM part")
def _(t):
    return t("part").select("p_partkey", T.secret_fingerprint(F.col("p_name")).alias("fingerprint"))


@query("c36_regions", "SELECT CASE event_type WHEN 'click' THEN 'hippocampus' WHEN 'purchase' THEN 'amygdala' ELSE 'neocortex' END AS region, count(*) AS n FROM events GROUP BY 1")
def _(t):
    kind = F.when(F.col("event_type") == "click", "Episodic").when(F.col("event_type") == "purchase", "emotional").otherwise(F.col("event_type"))
    return t("events").groupBy(T.region_for(kind).alias("region")).agg(F.count("*").alias("n"))


@query("c37_retry_delays", "SELECT CASE WHEN event_id % 4 = 0 THEN 1 ELSE least(greatest(floor(value)::INT, 1), 60) END::INT AS delay, count(*) AS n FROM events GROUP BY 1")
def _(t):
    asked = F.when(F.col("event_id") % 4 != 0, F.floor("value").cast("int"))
    return t("events").groupBy(T.retry_after(asked).alias("delay")).agg(F.count("*").alias("n"))


@query("k15_reports", OCC + " SELECT predicate, count(*) AS rows, count(DISTINCT domain) AS domains FROM occ GROUP BY 1")
def _(t):
    """A report a predicate written as one JSON document each, and read back."""
    path = _folder(t, "reports")
    report = occurrences(t).groupBy("predicate").agg(F.count("*").alias("rows"), F.count_distinct("domain").alias("domains"))
    IO.write_reports(report, path, "predicate")
    return IO.read_reports(t.spark, path, report.schema)
