"""Queries of the smaller operators: metrics, pressure, shares, policies, sets and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import accounting as A
from ..operators import audits as U
from ..operators import graph as G
from ..operators import refine as R
from .bindings import FACTS, OCC, occurrences
from .quality_queries import _RAW, _VALUES, aliases, triples
from ..operators.containment import contained
from .registry import query

_HOST = "regexp_replace(regexp_extract(lower(url), '^(?:[a-z]+://)?(?:[^/@]*@)?([^/:?#]+)', 1), '^www[.]', '')"


@query("a13_reconcile_pipeline", f"WITH v AS (SELECT why FROM lineitem JOIN (VALUES {_VALUES}) v(i, raw, why, mapped) ON i = (l_partkey + l_linenumber) % {len(_RAW)}) SELECT count(*) AS raw_triples, count(*) FILTER (why = 'ok') AS canonical, count(*) FILTER (why <> 'ok') AS rejected, 25::BIGINT AS persisted, 0::BIGINT AS unaccounted, count(*) FILTER (why = 'ok') - 25 AS merged FROM v")
def _(t):
    return A.reconcile(triples(t), R.refine(triples(t), aliases(t)), t("nation"))


@query("a19_reputable_triangulation", f"WITH p AS (SELECT {_HOST} AS h, html FROM pages), s AS (SELECT h, contains(lower(html), 'the') AS hit, CASE WHEN contains(h, '.edu') OR contains(h, '.gov') OR contains(h, '.org') OR contains(h, '.ac.') THEN 0.9 ELSE 0.6 END AS score FROM p) SELECT count(DISTINCT h) FILTER (hit AND score >= 0.7) AS domains, round(avg(score) FILTER (hit AND score >= 0.7), 4)::DOUBLE AS mean_score FROM s")
def _(t):
    h = T.domain_of(F.col("url"))
    rows = t("pages").select(h.alias("h"), F.contains(F.lower("html"), F.lit("the")).alias("hit"), R.domain_score(h).cast("double").alias("score"))
    ok = F.col("hit") & (F.col("score") >= 0.7)
    return rows.agg(F.count_distinct(F.when(ok, F.col("h"))).alias("domains"), F.round(F.avg(F.when(ok, F.col("score"))), 4).alias("mean_score"))


@query("a26_batch_summary", f"SELECT domain, count(*) AS pages, CAST(sum(n) AS BIGINT) AS links, max(n) AS most FROM (SELECT {_HOST} AS domain, len(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS n FROM pages) GROUP BY 1")
def _(t):
    rows = t("pages").select(T.domain_of(F.col("url")).alias("domain"), F.size(T.links(F.col("html"))).cast("bigint").alias("n"))
    return rows.groupBy("domain").agg(F.count("*").alias("pages"), F.sum("n").alias("links"), F.max("n").alias("most"))


@query("a28_cluster_acceptance", OCC + " SELECT object, count(DISTINCT domain) AS domains, count(DISTINCT url) AS urls, bool_and(confidence > 0.89) AS trusted, count(DISTINCT domain) >= 24 AND count(DISTINCT url) >= 2 AS eligible FROM occ GROUP BY 1")
def _(t):
    n = occurrences(t).groupBy("object").agg(F.count_distinct("domain").alias("domains"), F.count_distinct("url").alias("urls"), F.bool_and(F.col("confidence") > 0.89).alias("trusted"))
    return n.withColumn("eligible", (F.col("domains") >= 24) & (F.col("urls") >= 2))


@query("a30_three_source_agreement", "WITH p AS (SELECT user_id % 60 AS k, max(CASE event_type WHEN 'click' THEN event_id % 3 END) AS a, max(CASE event_type WHEN 'view' THEN event_id % 3 END) AS b, max(CASE event_type WHEN 'purchase' THEN event_id % 3 END) AS c FROM events GROUP BY 1) SELECT k, CASE WHEN a IS NULL OR b IS NULL OR c IS NULL THEN 'missing' WHEN a = b AND b = c THEN 'full' WHEN a = b OR b = c OR a = c THEN 'partial' ELSE 'none' END AS agreement FROM p")
def _(t):
    rows = t("events").select((F.col("user_id") % 60).alias("k"), "event_type", (F.col("event_id") % 3).alias("v"))
    p = rows.groupBy("k").pivot("event_type", ["click", "view", "purchase"]).agg(F.max("v"))
    a, b, c = F.col("click"), F.col("view"), F.col("purchase")
    kind = F.when(a.isNull() | b.isNull() | c.isNull(), "missing").when((a == b) & (b == c), "full").when((a == b) | (b == c) | (a == c), "partial").otherwise("none")
    return p.select("k", kind.alias("agreement"))


@query("a36_predicate_share", OCC + " SELECT round(count(*) FILTER (predicate = 'NF') / nullif(count(*), 0), 6) AS share FROM occ")
def _(t):
    return occurrences(t).agg(F.round(F.try_divide(F.count_if(F.col("predicate") == "NF"), F.count("*")), 6).alias("share"))


@query("a38_concept_uses", OCC + " SELECT concept, count(*) AS uses FROM (SELECT subject AS concept FROM occ UNION ALL SELECT object FROM occ) GROUP BY 1")
def _(t):
    return occurrences(t).select(F.explode(F.array("subject", "object")).alias("concept")).groupBy("concept").agg(F.count("*").alias("uses"))


@query("a39_metrics", FACTS + ", m AS (SELECT count(*) AS facts, count(*) FILTER (domains >= 24) AS verified FROM facts) SELECT facts, verified, round(verified / facts, 4) AS ratio, CASE WHEN verified / facts >= 0.8 THEN 'high' WHEN verified / facts >= 0.5 THEN 'medium' ELSE 'low' END AS pressure FROM m")
def _(t):
    m = G.facts(occurrences(t), 24).agg(F.count("*").alias("facts"), F.count_if("verified").alias("verified"))
    return m.withColumn("ratio", F.round(F.col("verified") / F.col("facts"), 4)).withColumn("pressure", U.pressure(F.col("verified"), F.col("facts")))


@query("a43_unknown_domains", "SELECT coalesce(CASE WHEN o_custkey % 5 <> 0 THEN 'd' || (o_custkey % 5) END, '<unknown>') AS domain, count(*) AS facts FROM orders GROUP BY 1")
def _(t):
    d = F.when(F.col("o_custkey") % 5 != 0, F.array(F.concat(F.lit("d"), F.col("o_custkey") % 5))).otherwise(F.array().cast("array<string>"))
    return t("orders").select(F.explode_outer(d).alias("domain")).groupBy(F.coalesce("domain", F.lit("<unknown>")).alias("domain")).agg(F.count("*").alias("facts"))


@query("a44_language_sides", "WITH g AS (SELECT source, bool_or(lang = 'en') AS a, bool_or(lang = 'fr') AS b FROM documents GROUP BY 1) SELECT source, CASE WHEN a AND b THEN 'both' WHEN a THEN 'en_only' WHEN b THEN 'fr_only' ELSE 'none' END AS side FROM g")
def _(t):
    g = t("documents").groupBy("source").agg(F.bool_or(F.col("lang") == "en").alias("a"), F.bool_or(F.col("lang") == "fr").alias("b"))
    return g.select("source", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "en_only").when(F.col("b"), "fr_only").otherwise("none").alias("side"))


@query("a48_table_gates", OCC + " SELECT count(*) AS with_url, count(DISTINCT fact_key) AS without_url, count(*) - count(DISTINCT fact_key) AS gap, count(*) > count(DISTINCT fact_key) AND count(DISTINCT fact_key) > 10 AS go FROM (SELECT DISTINCT fact_key, url FROM occ)")
def _(t):
    rows = G.confirmations(occurrences(t)).agg(F.count("*").alias("with_url"), F.count_distinct("fact_key").alias("without_url"))
    return rows.withColumn("gap", F.col("with_url") - F.col("without_url")).withColumn("go", (F.col("gap") > 0) & (F.col("without_url") > 10))


@query("a49_key_parity", "WITH m AS (SELECT user_id % 80 AS k, bool_or(event_type = 'click') AS a, bool_or(event_type = 'view') AS b, bool_or(event_type = 'purchase') AS c FROM events GROUP BY 1) SELECT k, CASE a::INT + b::INT + c::INT WHEN 3 THEN 'full' WHEN 0 THEN 'none' ELSE 'partial' END AS parity, array_to_string(list_filter([CASE WHEN NOT a THEN 'missing_a' END, CASE WHEN NOT b THEN 'missing_b' END, CASE WHEN NOT c THEN 'missing_c' END], lambda x: x IS NOT NULL), ',') AS causes FROM m")
def _(t):
    m = t("events").groupBy((F.col("user_id") % 80).alias("k")).agg(*[F.bool_or(F.col("event_type") == e).alias(n) for n, e in (("a", "click"), ("b", "view"), ("c", "purchase"))])
    n = sum((F.col(c).cast("int") for c in "abc"), F.lit(0))
    causes = F.array_compact(F.array(*[F.when(~F.col(c), f"missing_{c}") for c in "abc"]))
    return m.select("k", F.when(n == 3, "full").when(n == 0, "none").otherwise("partial").alias("parity"), F.array_join(causes, ",").alias("causes"))


@query("a51_probe_buckets", "SELECT CASE WHEN contains(text, ' the ') AND contains(text, ' and ') THEN 'both' WHEN contains(text, ' the ') THEN 'first' WHEN contains(text, ' and ') THEN 'second' ELSE 'neither' END AS bucket, count(*) AS n, min(strpos(text, ' the ')) AS first_at FROM documents GROUP BY 1")
def _(t):
    a, b = F.contains("text", F.lit(" the ")), F.contains("text", F.lit(" and "))
    bucket = F.when(a & b, "both").when(a, "first").when(b, "second").otherwise("neither")
    return t("documents").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min(F.locate(" the ", "text")).alias("first_at"))


@query("f24_soft_404", "SELECT page_id, ((contains(html, 'footer'))::INT + (contains(html, 'Thhe'))::INT + (contains(html, '/es/'))::INT + (contains(html, 'Wikip'))::INT) >= 2 AS missing FROM pages")
def _(t):
    n = sum((F.contains("html", F.lit(m)).cast("int") for m in ("footer", "Thhe", "/es/", "Wikip")), F.lit(0))
    return t("pages").select("page_id", (n >= 2).alias("missing"))


@query("f29_file_manifest", "SELECT page_id, strlen(html) AS bytes, sha256(html) AS hash, regexp_matches(url, '\\.(org|net)/') AND NOT contains(url, '/fr/') AS allowed FROM pages")
def _(t):
    ok = F.col("url").rlike(r"\.(org|net)/") & ~F.contains("url", F.lit("/fr/"))
    return t("pages").select("page_id", F.octet_length("html").cast("bigint").alias("bytes"), F.sha2("html", 256).alias("hash"), ok.alias("allowed"))


@query("f33_field_constraints", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.01 THEN 'confidence' WHEN l_quantity > 45 THEN 'length' END AS why FROM lineitem WHERE l_discount < 0.01 OR l_quantity > 45")
def _(t):
    why = F.when(F.col("l_discount") < 0.01, "confidence").when(F.col("l_quantity") > 45, "length")
    return t("lineitem").select("l_orderkey", "l_linenumber", why.alias("why")).filter("why is not null")


@query("f34_forbidden_objects", "SELECT p_partkey FROM part WHERE contains(upper(p_name), 'RING') OR contains(upper(p_name), 'BOLT')")
def _(t):
    up = F.upper("p_name")
    return t("part").filter(F.contains(up, F.lit("RING")) | F.contains(up, F.lit("BOLT"))).select("p_partkey")


@query("f32_readiness", "SELECT user_id, CASE WHEN count(*) < 50 THEN 'blocked:too_few' WHEN count(*) FILTER (event_type = 'error') * 4 > count(*) THEN 'blocked:errors' ELSE 'ready' END AS gate FROM events GROUP BY 1")
def _(t):
    n = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("e"))
    return n.select("user_id", F.when(F.col("n") < 50, "blocked:too_few").when(F.col("e") * 4 > F.col("n"), "blocked:errors").otherwise("ready").alias("gate"))


@query("j11_anti_join", OCC + " SELECT DISTINCT fact_key FROM occ WHERE fact_key NOT IN (SELECT fact_key FROM occ WHERE confidence > 0.995)")
def _(t):
    occ = G.with_keys(occurrences(t))
    return occ.select("fact_key").distinct().join(occ.filter("confidence > 0.995").select("fact_key"), "fact_key", "left_anti")


@query("j17_three_way_outer", "WITH a AS (SELECT user_id, count(*) AS a FROM events WHERE event_type = 'purchase' AND value > 10 GROUP BY 1), b AS (SELECT user_id, count(*) AS b FROM events WHERE event_type = 'click' AND value > 20 GROUP BY 1), c AS (SELECT user_id, count(*) AS c FROM events WHERE event_type = 'view' AND value > 30 GROUP BY 1) SELECT user_id, coalesce(a, b, c) AS n, CASE WHEN a IS NOT NULL THEN 'a' WHEN b IS NOT NULL THEN 'b' ELSE 'c' END AS origin FROM a FULL JOIN b USING (user_id) FULL JOIN c USING (user_id)")
def _(t):
    def part(kind, least, name):
        return t("events").filter((F.col("event_type") == kind) & (F.col("value") > least)).groupBy("user_id").agg(F.count("*").alias(name))

    rows = part("purchase", 10, "a").join(part("click", 20, "b"), "user_id", "full_outer").join(part("view", 30, "c"), "user_id", "full_outer")
    return rows.select("user_id", F.coalesce("a", "b", "c").alias("n"), F.when(F.col("a").isNotNull(), "a").when(F.col("b").isNotNull(), "b").otherwise("c").alias("origin"))


@query("j09_equal_predicate_token_overlap", "WITH n AS (SELECT p_type AS p, p_name AS name, min(p_partkey) AS k, string_split(p_name, ' ') AS w FROM part GROUP BY ALL) SELECT a.p AS kind, a.k AS a, b.k AS b FROM n a JOIN n b USING (p) WHERE a.name < b.name AND list_has_any(a.w, b.w)")
def _(t):
    """Names of one type that share a word; equal names are one, by their first part."""
    n = t("part").groupBy(F.col("p_type").alias("kind"), F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("k"))
    w = n.select("kind", "name", "k", F.explode(F.array_distinct(F.split("name", " "))).alias("w"))
    a, b = w.select("kind", "w", F.col("name").alias("x"), F.col("k").alias("a")), w.select("kind", "w", F.col("name").alias("y"), F.col("k").alias("b"))
    return a.join(b, ["kind", "w"]).filter("x < y").select("kind", "a", "b").distinct()


@query("t08_most_common", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def _(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("u03_domain_sets", OCC + ", s AS (SELECT object, list_sort(list(DISTINCT domain)) AS d FROM occ GROUP BY 1) SELECT a.object AS a, b.object AS b, a.d = b.d AS equal, len(list_intersect(a.d, b.d))::BIGINT AS shared FROM s a JOIN s b ON a.object < b.object AND len(list_intersect(a.d, b.d)) > 0")
def _(t):
    """Objects that share domains, joined on these; two sets are equal if both have no more than they share."""
    rows = occurrences(t).select("object", "domain").distinct()
    n = rows.groupBy("object").agg(F.count("*").alias("n"))
    rows = rows.join(n, "object")
    a, b = rows.select("domain", F.col("object").alias("a"), F.col("n").alias("n_a")), rows.select("domain", F.col("object").alias("b"), F.col("n").alias("n_b"))
    both = a.join(b, "domain").filter("a < b").groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("shared"))
    return both.select("a", "b", ((F.col("n_a") == F.col("shared")) & (F.col("n_b") == F.col("shared"))).alias("equal"), "shared")


@query("w15_stable_distinct", "SELECT user_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS kinds FROM (SELECT user_id, list(event_type ORDER BY event_id) AS l FROM events GROUP BY 1)")
def _(t):
    rows = t("events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("at")).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_type"))).alias("l"))
    return rows.select("user_id", F.array_join(F.transform("l", lambda x: x["event_type"]), ",").alias("kinds"))


@query("x08_running_accounting", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS seen, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 AS fresh FROM events")
def _(t):
    by = Window.partitionBy("user_id")
    return t("events").select("event_id", F.count("*").over(by.orderBy("event_id")).alias("seen"), (F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")) == 1).alias("fresh"))


@query("x11_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g) SELECT user_id, CAST(n AS BIGINT) AS session, count(*) AS events FROM s GROUP BY 1, 2")
def _(t):
    w = F.session_window("ts", "6 hours")
    rows = t("events").select("user_id", F.col("ts").cast("timestamp").alias("ts")).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("events"))
    return rows.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("w.start")).cast("bigint").alias("session"), "events")


@query(
    "j05_phrases_in_texts",
    r"""WITH w AS (SELECT list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS phrase FROM w WHERE len(w) >= 3),
d AS (SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> ''), ' ') AS t FROM documents)
SELECT phrase, count(*) AS documents, min(doc_id) AS first_doc FROM d JOIN p ON contains(t, phrase) GROUP BY phrase""",
)
def _(t):
    """In how many documents each stretch of three words of a benchmark item stands: all phrases are met at their rarest piece."""
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    triples = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " "))
    phrases = t("benchmark").select(words.alias("w")).filter("size(w) >= 3").select(F.explode(triples).alias("phrase")).distinct()
    texts = t("documents").select("doc_id", F.array_join(words, " ").alias("words"))
    found = contained(texts, ["doc_id"], "words", phrases, "phrase", small=0)
    return found.groupBy("phrase").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))
