"""Queries on extraction, retrieval, seeds and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocabulary import predicate_forms
from ..operators import extract as X
from ..operators import graph as G
from ..operators import questions as Q
from ..operators import refine as RF
from ..operators import retrieve as R
from ..operators import seeds as S
from ..operators import vectors as V
from ..sources import readers as IO
from .bindings import FACTS, OCC, occurrences
from .registry import query

_HOST = "regexp_replace(regexp_extract(lower(url), '^(?:[a-z]+://)?(?:[^/@]*@)?([^/:?#]+)', 1), '^www[.]', '')"
_VERBS = ("the", "que", "und", "los")


@query("g01_svo_triples", "SELECT doc_id, len(list_slice(regexp_extract_all(text, '(?i)((?:[\\p{L}\\p{N}-]+ ){1,4})(the|que|und|los) ((?:[\\p{L}\\p{N}-]+ ?){1,4})'), 1, 10))::BIGINT AS triples FROM documents WHERE len(regexp_extract_all(text, '(?i)((?:[\\p{L}\\p{N}-]+ ){1,4})(the|que|und|los) ((?:[\\p{L}\\p{N}-]+ ?){1,4})')) > 0")
def _(t):
    return X.svo(t("documents"), _VERBS).groupBy("doc_id").agg(F.count("*").alias("triples"))


_FORMS = predicate_forms()
FORM_ROWS = ", ".join(f"('{f}', '{p}')" for f, p in _FORMS.items())
_LONGEST_FIRST = "|".join(f.replace(" ", "  ") for f in sorted(_FORMS, key=len, reverse=True))


#: From clauses c (id, c) to triples t (id, subject, verb, object), by the same forms in order of length.
VERB_TRIPLES_SQL = rf"""w AS (SELECT id, regexp_extract_all(c, '[\p{{L}}\p{{N}}]+') AS w FROM c),
f AS (SELECT id, w, array_to_string(list_transform(w, lambda x: ' ' || regexp_replace(strip_accents(lower(x)), '[^a-z0-9]', '_', 'g') || ' '), '') AS f FROM w WHERE len(w) > 2),
m AS (SELECT id, w, string_split_regex(regexp_replace(f, ' ({_LONGEST_FIRST}) ', chr(1) || '\1' || chr(2), 'g'), '[\x01\x02]') AS m FROM f),
n AS (SELECT *, list_transform(m, lambda x: len(list_filter(string_split(x, ' '), lambda y: y <> ''))) AS n FROM m WHERE len(m) > 2),
j AS (SELECT *, unnest(range(1, (len(m) - 1) // 2 + 1)) AS j FROM n), a AS (SELECT *, list_sum(n[1:2 * j - 1])::BIGINT AS b FROM j),
t AS (SELECT id, array_to_string(w[b - least(n[2 * j - 1], 6) + 1:b], ' ') AS subject, replace(m[2 * j], '  ', ' ') AS verb, array_to_string(w[b + n[2 * j] + 1:b + n[2 * j] + least(n[2 * j + 1], 6)], ' ') AS object FROM a)"""


@query(
    "g02_verb_triples",
    rf"""WITH d AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '/' || turn, text FROM conversations),
c AS (SELECT id, unnest(string_split_regex(text, '[.;,:!?()\[\]\n\r]+')) AS c FROM d), {VERB_TRIPLES_SQL}
SELECT id, subject, predicate, object, count(*) AS n FROM t JOIN (VALUES {FORM_ROWS}) v(form, predicate) ON form = verb WHERE subject <> '' AND object <> '' GROUP BY ALL""",
)
def _(t):
    """Triples by the controlled verb forms, of all documents and turns of conversations."""
    said = t("conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("/"), "turn").alias("doc_id"), "text")
    rows = t("documents").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text").unionByName(said)
    return X.verb_triples(rows).groupBy(F.col("doc_id").alias("id"), "subject", "predicate", "object").agg(F.count("*").alias("n"))


@query("c26_triple_confidence", "SELECT p_partkey, round(least(0.99, 0.5::DOUBLE + CASE WHEN len(string_split(p_name, ' ')) <= 4 THEN 0.15 ELSE 0 END + CASE WHEN len(string_split(p_type, ' ')) <= 4 THEN 0.15 ELSE 0 END + CASE WHEN p_size > 25 THEN 0.15 ELSE 0 END), 2)::DOUBLE AS confidence FROM part")
def _(t):
    known = F.when(F.col("p_size") > 25, F.lit("SER"))
    return t("part").select("p_partkey", X.confidence(F.col("p_name"), known, F.col("p_type")).cast("double").alias("confidence"))


_SENT = "string_split_regex(trim(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g')), chr(1))"
_COPULA = r"^(\p{Lu}[\p{L}\p{N} -]{1,40}?) (?:é|foi|is|was) (?:um|uma|o|a|an|the) ([\p{L}\p{N} -]{2,40})"
_APPOSITION = r"^(\p{Lu}[\p{L}\p{N} -]{1,40}?), (?:um|uma|o|a|an|the) ([\p{L}\p{N} -]{2,40}),"


@query("g03_nominal_frames", f"""WITH s AS (SELECT doc_id, unnest({_SENT}) AS s FROM documents), m AS (SELECT doc_id, s, CASE WHEN regexp_matches(s, '{_COPULA}') THEN regexp_extract(s, '{_COPULA}', ['a', 'b']) WHEN regexp_matches(s, '{_APPOSITION}') THEN regexp_extract(s, '{_APPOSITION}', ['a', 'b']) END AS m FROM s)
SELECT doc_id, m.a AS subject, 'SER' AS predicate, trim(m.b) AS object FROM m WHERE m IS NOT NULL""")
def _(t):
    rows = t("documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("text"))
    return X.nominal(rows)


@query("w12_targets_first", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase')::INT DESC, event_id) AS r FROM events) WHERE r <= 25")
def _(t):
    return X.targets_first(t("events"), F.col("event_type") == "purchase", "user_id", "event_id").select("event_id", "user_id")


@query("w13_merge_bands", """WITH p AS (SELECT user_id AS k, event_id AS pos FROM events WHERE event_type = 'purchase'), f AS (SELECT user_id AS k, event_id AS pos FROM events WHERE event_type = 'click'),
n AS (SELECT k FROM p GROUP BY 1 HAVING count(*) >= 12), u AS (SELECT k, pos, 1 AS b FROM p UNION ALL SELECT k, pos, 0 FROM f WHERE k NOT IN (SELECT k FROM n)), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY b, pos) AS r FROM u) SELECT k, pos FROM r WHERE r <= 25""")
def _(t):
    rows = t("events").select("event_type", F.col("user_id").alias("k"), F.col("event_id").alias("pos"), F.concat(F.lit("S"), "event_id").alias("subject"), F.lit("p").alias("predicate"), F.lit("o").alias("object"))
    return X.merge_bands(rows.filter("event_type = 'purchase'"), rows.filter("event_type = 'click'"), "k", 12).select("k", "pos")


@query("g06_winner_lines", "WITH l AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') || '  Club ' || o_orderstatus WHEN 1 THEN strftime(o_orderdate, '%Y') || ' Vice club' WHEN 2 THEN 'Final 3-1' ELSE 'no year here' END AS line, CASE o_orderkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'runner_up' WHEN 2 THEN 'score' ELSE 'unmatched' END AS reason FROM orders) SELECT CASE WHEN reason = 'ok' THEN CAST(line[1:4] AS INT) END AS year, CASE WHEN reason = 'ok' THEN line[7:] END AS club, reason, count(*) AS n FROM l GROUP BY 1, 2, 3")
def _(t):
    k, y = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy")
    line = F.when(k == 0, F.concat(y, F.lit("  Club "), "o_orderstatus")).when(k == 1, F.concat(y, F.lit(" Vice club"))).when(k == 2, "Final 3-1").otherwise("no year here")
    rows = t("orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("pos"), line.alias("line"))
    return X.winners(rows).groupBy("year", "club", "reason").agg(F.count("*").alias("n"))


@query("g07_table_honours", "SELECT p_partkey AS page_id, p_brand AS subject, 'VENCEU' AS predicate, p_type AS object, 1900 + p_size AS year FROM part WHERE p_type IN ('PROMO', 'SMALL') UNION ALL SELECT p_partkey, p_brand, 'VENCEU', p_type, 1950 + p_size FROM part WHERE p_type IN ('PROMO', 'SMALL')")
def _(t):
    p = t("part")
    html = F.concat(F.lit("<table><tr><th>Club</th><th>Competition</th><th>Years</th></tr><tr><td>"), "p_brand", F.lit("</td><td><b>"), "p_type", F.lit("</b></td><td>"), (F.col("p_size") + 1900).cast("string"), F.lit(", "), (F.col("p_size") + 1950).cast("string"), F.lit("</td></tr></table>"))
    rows = X.table_rows(p.select(F.col("p_partkey").alias("page_id"), html.alias("html")))
    allowed = p.filter(F.col("p_type").isin("PROMO", "SMALL")).select(F.col("p_brand").alias("club"), F.col("p_type").alias("competition")).distinct()
    return X.honours(rows, allowed)


@query("g11_geo_cities", "WITH e AS (SELECT s_suppkey, 'stadium ' || (s_suppkey % 30) AS stadium, n_name AS city FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 7 <> 0) SELECT stadium AS subject, 'LOCALIZADO_EM' AS predicate, min(city) AS object FROM e GROUP BY 1 HAVING count(DISTINCT lower(city)) = 1")
def _(t):
    s = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.concat(F.lit("The Stadium "), F.col("s_suppkey") % 30, F.lit(" ground"))
    kind = F.when(F.col("s_suppkey") % 7 == 0, "highway").otherwise("leisure")
    entry = F.to_json(F.struct(F.col("s_suppkey").alias("place_id"), name.alias("name"), kind.alias("class"), F.lit("stadium").alias("type"), F.create_map(F.lit("city"), F.col("n_name")).alias("address")))
    alias = t("supplier").select((F.col("s_suppkey") % 30).alias("k")).distinct()
    alias = alias.select(F.concat(F.lit("stadium "), "k", F.lit(" ground")).alias("alias"), F.concat(F.lit("stadium "), "k").alias("stadium"))
    return X.geo_cities(s.select(entry.alias("json")), alias)


@query("g13_located_pages", "SELECT p_partkey AS page_id, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN 'Santos' END AS city, CASE p_partkey % 3 WHEN 0 THEN 0.95 ELSE 0.9 END::DOUBLE AS confidence FROM part WHERE p_partkey % 3 < 2")
def _(t):
    k = F.col("p_partkey") % 3
    html = F.when(k == 0, F.concat(F.lit("<table><tr><th>City</th><td><a href='x'>"), "p_type", F.lit("</a></td></tr></table>"))).when(k == 1, "<p>It is a ground located in Santos.</p>").otherwise("<p>No place.</p>")
    return X.located(t("part").select(F.col("p_partkey").alias("page_id"), html.alias("html"))).withColumn("confidence", F.col("confidence").cast("double"))


@query("g16_cooccurrences", f"""WITH s AS (SELECT doc_id, unnest({_SENT}) AS s FROM documents), k AS (SELECT doc_id, trim(regexp_replace(strip_accents(replace(lower(s), 'ß', ' ')), '[^a-z0-9]+', ' ', 'g')) AS k FROM s WHERE trim(s) <> '')
SELECT doc_id, a, b, count(*) AS sentences FROM k, (VALUES ('the'), ('que')) x(a), (VALUES ('and'), ('les')) y(b) WHERE contains(k, a) AND contains(k, b) GROUP BY 1, 2, 3""")
def _(t):
    a = t.spark.createDataFrame([("the",), ("que",)], "name string")
    b = t.spark.createDataFrame([("and",), ("les",)], "name string")
    return X.cooccurrences(t("documents"), a, b)


@query("f26_target_match", "SELECT doc_id FROM documents WHERE (contains(f, 'tion of') OR contains(f, 'que la')) AND (contains(f, 'the er') OR contains(f, 'et de'))".replace("FROM documents", "FROM (SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')) AS f FROM documents)"))
def _(t):
    return t("documents").filter(X.target_match(F.col("text"), ("tion of", "que la"), ("the er", "et de"))).select("doc_id")


@query("g14_payloads", OCC + " SELECT url, count(*) AS n, count(*) AS entities FROM (SELECT DISTINCT url, subject, predicate, object FROM occ) GROUP BY 1")
def _(t):
    rows = occurrences(t).select("url", "subject", "predicate", "object").distinct()
    return X.payloads(rows).withColumn("entities", F.size("entities").cast("bigint"))


@query("g18_episode_payloads", "SELECT event_id, 'u' || user_id AS subject, event_type AS predicate FROM events WHERE event_type <> 'error'")
def _(t):
    rows = t("events").select("event_id", F.array(F.struct(F.concat(F.lit("u"), "user_id").alias("subject"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("predicate"))).alias("entities"))
    return rows.select("event_id", F.inline("entities")).filter("predicate is not null")


@query("r08_relation_search", FACTS + ", h AS (SELECT subject, predicate, object, (contains(x, 'brand#7'))::INT + (contains(x, 'promo'))::INT AS hits FROM (SELECT *, lower(subject || ' ' || predicate || ' ' || object) AS x FROM facts)) SELECT * FROM h WHERE hits > 0 ORDER BY hits DESC, subject, predicate, object LIMIT 8")
def _(t):
    return R.relation_search(G.facts(occurrences(t)).select("subject", "predicate", "object"), "a brand#7 or PROMO")


@query("r04_hybrid_context")
def _(t):
    occ = occurrences(t)
    facts = G.verified_export(occ, G.facts(occ)).limit(5)
    d, e = t("documents"), t("embeddings")
    q = e.filter("vec_id = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    near = V.top_k(q, e.select("vec_id", F.col("embedding").alias("v"))).join(d, F.col("vec_id") == F.col("doc_id")).select("text")
    edges = G.relations(occ).select(F.xxhash64("subject", "predicate", "object").alias("id"), "subject", "predicate", "object")
    return R.hybrid_context(facts, near, G.paths(edges, "Brand#7", 5))


@query(
    "r05_extractive_answers",
    FACTS
    + """, q AS (SELECT DISTINCT p_brand AS question FROM part), r AS (SELECT f.*, row_number() OVER (PARTITION BY subject ORDER BY predicate, object) AS pos FROM facts f WHERE domains >= 24)
SELECT question, CASE WHEN count(r.pos) = 0 THEN 'No facts are known about this.' ELSE string_agg('- ' || predicate || ' ' || object, chr(10) ORDER BY pos) FILTER (pos <= 5) END AS reply, count(r.pos) > 0 AS verified FROM q LEFT JOIN r ON subject = question GROUP BY 1""",
)
def _(t):
    from pyspark.sql.window import Window

    facts = G.facts(occurrences(t), 24).filter("verified")
    rows = facts.select(F.col("subject").alias("question"), F.concat_ws(" ", "predicate", "object").alias("text"), F.col("fact_key").alias("source"), "verified", F.row_number().over(Window.partitionBy("subject").orderBy("predicate", "object")).alias("pos"))
    asked = t("part").select(F.col("p_brand").alias("question")).distinct()
    return R.answer(asked.join(rows, "question", "left")).drop("sources")


@query("c35_knowledge_gap", "SELECT c_custkey, count(o_orderkey) AS facts, CASE WHEN count(o_orderkey) = 0 THEN 'search' WHEN count(o_orderkey) < 3 THEN 'expand' ELSE 'reflect' END AS decision FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    n = t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("facts"))
    return R.knowledge_gap(n)


@query("r06_retrieve_or_search", "WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id), m AS (SELECT query_id, arg_max(vec_id, s) AS v, max(s) AS s FROM s GROUP BY 1) SELECT query_id, CASE WHEN s >= 0.4 THEN v END AS vec_id, CASE WHEN s >= 0.4 THEN 'memory' ELSE 'search' END AS origin FROM m")
def _(t):
    e = t("embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    hits = V.top_k(q, e.select("vec_id", F.col("embedding").alias("v")), 2).filter("query_id <> vec_id")
    return R.nearest_or_search(hits, 0.4)


@query("r07_quarantine_tee", f"SELECT url, 'low_score' AS reason FROM (SELECT url, {_HOST} AS h FROM pages) WHERE NOT ends_with(h, '.org')")
def _(t):
    h = T.domain_of(F.col("url"))
    rows = t("pages").select("url", RF.domain_score(h).alias("score"))
    return R.fetch_and_verify(rows, 0.8)[1].select("url", "reason")


@query("c39_sft_records", FACTS + " SELECT 'What is known of ' || subject || '?' AS instruction, subject || ' ' || lower(predicate) || ' ' || object || ' (confirmed by ' || urls || CASE WHEN urls = 1 THEN ' source)' ELSE ' sources)' END AS output FROM facts WHERE verified")
def _(t):
    occ = occurrences(t)
    rows = G.verified_export(occ, G.facts(occ)).withColumn("source_domains", F.array_join("source_domains", ","))
    return R.sft_records(rows).select("instruction", "output")


@query("w14_longest_keyword", "WITH k AS (SELECT conv_id, turn, list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 6) AS w FROM (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]{2,}'), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in T.KEYWORD_STOPWORDS) + ")) AS w FROM conversations)) SELECT conv_id, turn, list_filter(w, lambda x: length(x) = list_max(list_transform(w, lambda y: length(y))))[1] AS longest FROM k")
def _(t):
    return R.keywords_of(t("conversations")).select("conv_id", "turn", "longest")


def _seed_rows(t):
    return t("pages").select((F.col("page_id") % 20).alias("cluster"), "url", T.domain_of(F.col("url")).alias("domain"), T.base_domain(T.domain_of(F.col("url"))).alias("publisher"))


_SEEDS = f"WITH s AS (SELECT page_id % 20 AS cluster, url, h AS domain, array_to_string(list_slice(string_split(h, '.'), -2, -1), '.') AS publisher FROM (SELECT page_id, url, {_HOST} AS h FROM pages))"


@query("f19_validate_seed_clusters", _SEEDS + " SELECT cluster, count(DISTINCT domain) AS domains, count(DISTINCT publisher) AS publishers, array_to_string(list_filter([CASE WHEN count(DISTINCT domain) < 8 THEN 'too_few_domains' END, CASE WHEN count(DISTINCT publisher) < 4 THEN 'too_few_publishers' END, CASE WHEN count(*) FILTER (NOT starts_with(url, 'https://')) > 0 THEN 'not_https' END, CASE WHEN count(DISTINCT url) < count(*) THEN 'duplicate_url' END], lambda x: x IS NOT NULL), ',') AS errors FROM s GROUP BY 1")
def _(t):
    return S.validate_clusters(_seed_rows(t), 8, 4)


@query("a27_manifest_health", _SEEDS + " SELECT count(DISTINCT cluster) AS clusters, count(DISTINCT url) AS urls, count(DISTINCT domain) AS domains, count(DISTINCT publisher) AS publishers FROM s")
def _(t):
    return S.manifest_health(_seed_rows(t))


@query("w10_first_per_domain", f"SELECT domain, min(page_id) AS page_id FROM (SELECT page_id, {_HOST} AS domain FROM pages) GROUP BY 1")
def _(t):
    return S.first_per(t("pages").select(T.domain_of(F.col("url")).alias("domain"), "page_id"), "domain", "page_id")


@query("x12_request_budget", f"SELECT page_id, domain FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY page_id) AS r FROM (SELECT page_id, {_HOST} AS domain FROM pages)) WHERE r <= 3 ORDER BY page_id LIMIT 100")
def _(t):
    rows = t("pages").select("page_id", T.domain_of(F.col("url")).alias("domain"))
    return S.budget(rows, 100, 3, "domain", "page_id")


@query("w09_pilot_selection", "SELECT s_suppkey AS id, s_nationkey AS risk FROM supplier WHERE s_acctbal > 0 ORDER BY risk, id LIMIT 10")
def _(t):
    rows = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("risk"), "s_acctbal")
    return S.select_pilot(rows, F.col("s_acctbal") > 0).select("id", "risk")


@query("f20_candidate_reasons", "SELECT page_id, CASE WHEN NOT starts_with(url, 'https://') THEN 'not_https' WHEN contains(url, '/fr/') THEN 'blocked' WHEN len(list_filter(string_split(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/'), lambda x: x <> '')) < 2 THEN 'section_page' END AS reason FROM pages")
def _(t):
    return t("pages").select("page_id", S.candidate_reason(F.col("url"), ("/fr/",)).alias("reason"))


@query("s09_batches_of_50", "SELECT batch, count(*) AS n FROM (SELECT ceil(row_number() OVER (ORDER BY o_orderkey) / 50)::BIGINT AS batch FROM orders) GROUP BY 1")
def _(t):
    return S.batches(t("orders").select("o_orderkey"), "o_orderkey").groupBy("batch").agg(F.count("*").alias("n"))


@query("s19_merge_url_lists", "SELECT url, min(l) AS list FROM (SELECT url, 0 AS l FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT url, 1 FROM pages WHERE page_id % 2 = 0) GROUP BY 1")
def _(t):
    p = t("pages").select("url", F.col("page_id").alias("pos"))
    return S.merged(p.filter("pos % 3 = 0"), p.filter("pos % 2 = 0")).select("url", "list")


@query("s15_worker_log", "SELECT 'u' || user_id AS url, arg_max(event_type, event_id) AS status, arg_max(CAST(json_extract(props, '$.k') AS BIGINT), event_id) AS accepted FROM events GROUP BY 1")
def _(t):
    body = F.concat(F.lit('{"status": "'), "event_type", F.lit('", "accepted": '), F.get_json_object("props", "$.k"), F.lit("}"))
    line = F.concat(F.lit("INFO ingest u"), "user_id", F.lit("="), body)
    return IO.worker_log(t("events").select(F.col("event_id").alias("pos"), line.alias("value")))


@query("s05_transcripts", "WITH l AS (SELECT conv_id AS file, turn AS pos, role AS x FROM conversations) SELECT file, string_agg(x, ' ' ORDER BY pos) AS text FROM (SELECT *, lag(x) OVER (PARTITION BY file ORDER BY pos) AS b FROM l) WHERE b IS NULL OR b <> x GROUP BY 1")
def _(t):
    c = t("conversations")
    lines = c.select(F.col("conv_id").alias("file"), F.explode(F.array(F.struct((F.col("turn") * 3).alias("pos"), F.col("turn").cast("string").alias("value")), F.struct((F.col("turn") * 3 + 1).alias("pos"), F.lit("00:01.000 --> 00:02.000").alias("value")), F.struct((F.col("turn") * 3 + 2).alias("pos"), F.concat(F.lit("<c>"), "role", F.lit("</c>")).alias("value")))).alias("x"))
    return IO.transcript(lines.select("file", "x.pos", "x.value"))


@query("s04_feed_items", "SELECT 'u' || n_regionkey AS url, n_name AS title, 'http://x/' || n_nationkey AS link FROM nation")
def _(t):
    item = F.concat(F.lit("<item><title>"), "n_name", F.lit("</title><link>http://x/"), "n_nationkey", F.lit("</link></item>"))
    xml = t("nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("i"))
    return IO.feed(xml.select(F.concat(F.lit("u"), "n_regionkey").alias("url"), F.concat(F.lit("<rss><channel>"), "i", F.lit("</channel></rss>")).alias("xml")))


@query("s03_decode_bytes", "SELECT doc_id, md5(text) AS text FROM documents")
def _(t):
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1"))
    return t("documents").select("doc_id", F.md5(T.decode_bytes(raw)).alias("text"))


@query("c34_clean_json", "SELECT event_id, props AS json FROM events")
def _(t):
    said = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n``` done"))
    return t("events").select("event_id", T.clean_json(said).alias("json"))


@query("c43_unwrap_links", "SELECT page_id, url AS target FROM pages")
def _(t):
    link = F.concat(F.lit("https://r.example/l?uddg="), F.url_encode("url"))
    return t("pages").select("page_id", T.query_target(F.when(F.col("page_id") % 2 == 0, link).otherwise(F.col("url"))).alias("target"))


@query("c06_singular", "SELECT p_partkey, CASE WHEN ends_with(w, 's') AND length(w) > 3 AND NOT ends_with(w, 'ss') THEN w[1:-2] ELSE w END AS w FROM (SELECT p_partkey, p_name || CASE p_size % 3 WHEN 0 THEN 's' WHEN 1 THEN 'ss' ELSE '' END AS w FROM part)")
def _(t):
    w = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, "s").when(F.col("p_size") % 3 == 1, "ss").otherwise(""))
    return t("part").select("p_partkey", T.singular(w).alias("w"))


_WORDS = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]{2,}'), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in T.KEYWORD_STOPWORDS) + "))"


@query(
    "r04_context_of_many",
    OCC
    + f""", e AS (SELECT DISTINCT subject, predicate, object, subject || '>' || predicate || '>' || object AS id FROM occ), q AS (SELECT vec_id AS question_id, embedding AS v, p_brand || ' of ' || p_type AS text FROM embeddings JOIN part ON p_partkey = vec_id + 1),
w AS (SELECT question_id, list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 6) AS w FROM (SELECT question_id, {_WORDS} AS w FROM q)),
t AS (SELECT question_id, unnest(w) AS term FROM w), m AS (SELECT question_id, list_filter(w, lambda x: length(x) = list_max(list_transform(w, lambda y: length(y))))[1] AS term FROM w),
h AS (SELECT DISTINCT question_id, subject, predicate, object FROM t JOIN e ON contains(lower(subject), term) OR contains(lower(object), term)),
f AS (SELECT question_id, 0 AS k, subject || ' ' || predicate || ' ' || object AS text FROM h QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY subject, predicate, object) <= 8),
v AS (SELECT q.question_id, 1 AS k, 'memory ' || x.vec_id AS text FROM q, embeddings x QUALIFY row_number() OVER (PARTITION BY q.question_id ORDER BY list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]) DESC, x.vec_id) <= 3),
b AS (SELECT id, subject AS a, predicate, object AS b FROM e UNION ALL SELECT id, object, predicate, subject FROM e), mt AS (SELECT DISTINCT term FROM m),
o AS (SELECT term, b.* FROM mt JOIN b ON contains(lower(a), term)),
p AS (SELECT DISTINCT term, 1 AS hops, a AS origin, [predicate] AS relations, b AS target FROM o UNION SELECT DISTINCT term, 2, o.a, [o.predicate, b.predicate], b.b FROM o JOIN b ON b.a = o.b AND b.id <> o.id),
r AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY term ORDER BY hops, origin, relations, target) <= 15),
g AS (SELECT question_id, 2 AS k, origin || ' via [' || array_to_string(relations, ' -> ') || '] ' || target AS text FROM m JOIN r USING (term)),
u AS (FROM f UNION ALL FROM v UNION ALL FROM g)
SELECT question_id, text, CASE min(k) WHEN 0 THEN 'fact' WHEN 1 THEN 'vector' ELSE 'path' END AS kind FROM u GROUP BY question_id, text""",
)
def _(t):
    """A question about a brand and type for each vector: facts, nearest vectors and paths around its main term."""
    e = t("embeddings")
    asked = e.join(t("part"), F.col("p_partkey") == F.col("vec_id") + 1).select(F.col("vec_id").alias("question_id"), F.concat("p_brand", F.lit(" of "), "p_type").alias("text"), "embedding")
    edges = occurrences(t).select("subject", "predicate", "object").distinct().withColumn("id", F.concat_ws(">", "subject", "predicate", "object"))
    near = V.top_k(asked.select(F.col("question_id").alias("query_id"), F.col("embedding").alias("q")), e.select("vec_id", F.col("embedding").alias("v")), 3)
    hits = near.select(F.col("query_id").alias("question_id"), F.concat(F.lit("memory "), "vec_id").alias("text"))
    return Q.context(asked.select("question_id", "text"), edges, hits)
