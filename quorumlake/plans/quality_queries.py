"""Queries on text, gates, refinement and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import audits as U
from ..operators import graph as G
from ..operators import refine as R
from .bindings import FACTS, OCC, occurrences
from .registry import query

_HOST = "regexp_replace(regexp_extract(lower(url), '^(?:[a-z]+://)?(?:[^/@]*@)?([^/:?#]+)', 1), '^www[.]', '')"
_FOLD = "trim(regexp_replace(strip_accents(replace(lower(text), 'ß', ' ')), '[^a-z0-9]+', ' ', 'g'))"
_FLAT = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _any(words, of):
    return "(" + " OR ".join(f"contains({of}, '{w}')" for w in words) + ")"


def _list(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query("c02_fold", f"SELECT doc_id, md5({_FOLD}) AS folded FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5(T.fold_span(F.col("text"))).alias("folded"))


@query("c01_fold_key", "SELECT n_nationkey, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower('The A ' || n_name || '-X.'), '[_-]+', ' ', 'g'), '[^a-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g')), '^(?:(?:the|a|o) )+', '') AS key FROM nation")
def _(t):
    return t("nation").select("n_nationkey", T.fold_key(F.concat(F.lit("The A "), "n_name", F.lit("-X."))).alias("key"))


@query("c31_match_key", "SELECT p_partkey, upper(regexp_replace(lower(p_name || '/' || p_brand), '[^a-z0-9]', '', 'g')) AS key FROM part")
def _(t):
    return t("part").select("p_partkey", T.match_key(F.concat("p_name", F.lit("/"), "p_brand")).alias("key"))


_SENT = "list_filter(string_split_regex(trim(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g')), chr(1)), lambda x: trim(x) <> '')"


@query("c21_sentences", f"SELECT doc_id, len(s)::BIGINT AS sentences, s[1] AS first FROM (SELECT doc_id, {_SENT} AS s FROM documents)")
def _(t):
    rows = t("documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("bigint").alias("sentences"), F.get("s", F.lit(0)).alias("first"))


@query("c20_keywords", f"SELECT conv_id, turn, array_to_string(list_slice(list_distinct_in_order, 1, 6), ',') AS keywords FROM (SELECT conv_id, turn, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_in_order FROM (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]{{2,}}'), lambda x: x NOT IN {_list(T.KEYWORD_STOPWORDS)}) AS w FROM conversations))")
def _(t):
    return t("conversations").select("conv_id", "turn", F.array_join(T.keywords(F.col("text")), ",").alias("keywords"))


@query("c28_strip_html", "SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text FROM pages")
def _(t):
    return t("pages").select("page_id", F.md5(T.strip_html(F.col("html"))).alias("text"))


@query("c27_titles", "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def _(t):
    return t("pages").select("page_id", T.html_title(F.col("html")).alias("title"))


@query("g17_links", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages")
def _(t):
    return t("pages").select("page_id", F.explode(T.links(F.col("html"))).alias("href"))


@query("c29_mask_secrets", "SELECT doc_id, md5(regexp_replace(text, '(?i)((?:password|passwd|secret|token|api_?key) *[=:] *[\"'']?)[A-Za-z0-9+/_.=-]{8,}', '\\1***', 'g')) AS masked FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5(T.mask_secrets(F.col("text"))).alias("masked"))


@query("f28_secret_markers", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"'{m}'" for m in R.SECRET_MARKERS) + "], lambda m: contains(lower(text), m)), ',') AS markers FROM documents")
def _(t):
    return t("documents").select("doc_id", F.array_join(R.secret_markers(F.col("text")), ",").alias("markers"))


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)"
_L = _FLAT.format(x="x")


@query("f03_noisy_sentences", f"WITH {_LINES} SELECT doc_id, count(*) AS lines, count(*) FILTER (length({_L}) BETWEEN 15 AND 320 AND NOT ends_with({_L}, '?') AND NOT regexp_matches(lower({_L}), '^({'|'.join(V.IMPERATIVES)})') AND NOT {_any(V.UI_MARKERS, f'lower({_L})')}) AS kept FROM l GROUP BY 1")
def _(t):
    rows = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count(R.noisy_sentence(F.col("x"))).alias("kept"))


_FORMS = [k for k in sorted(V.predicate_forms()) if " " not in k]


@query("f04_sentence_scores", f"""WITH {_LINES}, s AS (SELECT {_L} AS x FROM l), v AS (SELECT x, lower(x) AS low, list_has_any(string_split(trim(regexp_replace(strip_accents(lower(x)), '[^a-z0-9]+', ' ', 'g')), ' '), {_list(_FORMS).replace('(', '[').replace(')', ']')}) AS p FROM s)
SELECT CASE WHEN x = '' THEN 0.0 ELSE greatest(0, least(10, 5 + CASE WHEN p THEN 2 ELSE 0 END + CASE WHEN length(x) BETWEEN 40 AND 220 THEN 1 ELSE 0 END - CASE WHEN {_any(V.UI_MARKERS, 'low')} THEN 5 ELSE 0 END - CASE WHEN regexp_matches(low, '^({'|'.join(V.IMPERATIVES)})') OR ends_with(x, '?') THEN 3 ELSE 0 END)) / 10 END::DOUBLE AS score, count(*) AS n FROM v GROUP BY 1""")
def _(t):
    # each line is scored once, however often it comes
    rows = t("documents").select(F.explode(F.split("text", "\n")).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    return rows.groupBy(R.sentence_score(F.col("x")).cast("double").alias("score")).agg(F.sum("n").alias("n"))


#: Word boundaries are spelled out: those of the two engines differ at letters with accents.
_B, _E = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
_NOISE = rf"(?i)[\x{{200b}}\x{{2060}}\x{{feff}}]|{_B}image (?:source|caption){_E}|{_B}copy link{_E}|{_B}share page{_E}|^\W*[0-9]{{4}}\s*\)|^\s*(?:retrieved|archived) [0-9]|{_B}jump (?:up|to){_E}"
_VERBAL = (
    rf"(?i:{_B}(?:is|are|was|were|be|been|has|have|had|do|does|did|will|would|can|could|won|played|held|led|made|became|founded|called|born|uses|includes|foi|era|tem){_E})"
    rf"|\p{{L}}{{2,}}(?i:ed|ing|ou|eu|iu|ava|aram|ando|endo|indo|ado|ido|ada|ida){_E}|{_B}(?:é|[Ss]ã[Oo]|[Ee][Ss][Tt]á){_E}"
)
_NAV = rf"(?i)^(?:see also|external links?|further reading|bibliography|contents|notes?|ver também|refer[êe]ncias|edit(?:ar)?$|full name|nickname|date of birth){_E}"
_CANDIDATE = (
    "CASE WHEN len(regexp_extract_all(x, '\\p{L}{2,}')) < 3 THEN 'too_short' WHEN regexp_matches(x, '" + _NOISE + "') THEN 'noise_marker' WHEN regexp_matches(x, '" + _VERBAL + "') THEN 'ok' WHEN regexp_matches(x, '" + _NAV + "') THEN 'noise_marker' "
    "WHEN len(regexp_extract_all(x, '[0-9]+')) >= 2 THEN 'non_propositional_fragment' WHEN len(regexp_extract_all(x, '\\p{L}{2,}')) >= 4 AND (contains(x, ',') OR len(regexp_extract_all(x, '\\s\\p{Lu}')) >= 2) THEN 'ok' ELSE 'non_propositional_fragment' END"
)


@query("f01_sentence_candidates", f"SELECT {_CANDIDATE} AS reason, count(*) AS n FROM (SELECT {_FLAT.format(x='s')} AS x FROM (SELECT unnest({_SENT}) AS s FROM documents)) GROUP BY 1")
def _(t):
    rows = t("documents").select(F.explode(T.sentences(F.col("text"))).alias("x"))
    return rows.groupBy(F.coalesce(R.sentence_reason(F.col("x")), F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


_RAW = ("usa", "UTILIZA", "é", "2020", "século XX", "http://x.org", "poder", "Passou", "of", "years", "learn", "zzz", "", "venceu", "won", "fica em", "publicou", "a=b")
_WHY = ("ok", "ok", "ok", "numeric_predicate", "numeric_predicate", "url_or_code_predicate", "modal_predicate", "ambiguous_predicate", "stopword_predicate", "nonverbal_predicate", "unmapped_predicate", "invalid_predicate", "invalid_predicate", "ok", "ok", "ok", "ok", "url_or_code_predicate")
_MAPPED = ("UTILIZA", "UTILIZA", "SER", None, None, None, None, None, None, None, None, None, None, "VENCEU", "VENCEU", "LOCALIZADO_EM", "PRODUZ", None)
_VALUES = ", ".join(f"({i}, '{r}', '{w}', {f'{chr(39)}{m}{chr(39)}' if m else 'NULL'})" for i, (r, w, m) in enumerate(zip(_RAW, _WHY, _MAPPED, strict=True)))


def raw_predicate(key):
    return F.element_at(F.array(*[F.lit(x) for x in _RAW]), (key % len(_RAW) + 1).cast("int"))


@query("f06_validate_predicate", f"SELECT raw, why AS reason, mapped AS canonical, count(*) AS n FROM lineitem JOIN (VALUES {_VALUES}) v(i, raw, why, mapped) ON i = (l_partkey + l_linenumber) % {len(_RAW)} GROUP BY 1, 2, 3")
def _(t):
    rows = t("lineitem").select(raw_predicate(F.col("l_partkey") + F.col("l_linenumber")).alias("raw"))
    rows = rows.groupBy("raw").agg(F.count("*").alias("n"))
    return rows.select("raw", R.predicate_reason(F.col("raw")).alias("reason"), R.map_predicate(F.col("raw")).alias("canonical"), "n")


_SPANS = ("Rio Branco", "em Santos", "o que vier", "1999", "anos 90", "they", "cada dia", "x{1}", "12 34", "know by the many long words of this very long span", "durante o jogo", "quem", "eliminated by Santos", "Rio Negro")
_S_WHY = (None, "object_prepositional_phrase", "object_clause_fragment", "object_numeric_only", "object_date_like", "object_pronoun", "object_generic_phrase", "object_punctuated", "object_numeric_only", "object_too_long", "object_adverbial_phrase", "object_pronoun", "object_predicate_complement", None)
_S_VALUES = ", ".join(f"({i}, '{s}', {f'{chr(39)}{w}{chr(39)}' if w else 'NULL'})" for i, (s, w) in enumerate(zip(_SPANS, _S_WHY, strict=True)))


@query("f08_span_reasons", f"SELECT span, why AS reason, count(*) AS n FROM orders JOIN (VALUES {_S_VALUES}) v(i, span, why) ON i = o_orderkey % {len(_SPANS)} GROUP BY 1, 2")
def _(t):
    span = F.element_at(F.array(*[F.lit(x) for x in _SPANS]), (F.col("o_orderkey") % len(_SPANS) + 1).cast("int"))
    rows = t("orders").select(span.alias("span")).groupBy("span").agg(F.count("*").alias("n"))
    return rows.select("span", R.span_reason(F.col("span"), "object", None, F.lit("SER")).alias("reason"), "n")


def triples(t):
    """Line items with a raw predicate by their keys."""
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("p_name").alias("subject"), raw_predicate(F.col("l_partkey") + F.col("l_linenumber")).alias("predicate"), F.concat("p_type", F.lit(" "), F.translate("p_brand", "#", "")).alias("object"), (1.2 - F.col("l_discount") * 10).alias("confidence"))


def aliases(t):
    return R.alias_table(t("part").select(F.lit("RED WIDGETS").alias("canonical"), F.lit("The red-widget").alias("variant")).limit(1))


_REFINED = f"""WITH r AS (SELECT CASE WHEN p_name = 'red widget' THEN 'RED WIDGETS' ELSE upper(p_name) END AS c_subject, upper(p_type || ' ' || replace(p_brand, '#', '')) AS c_object, mapped AS c_predicate,
  round(greatest(0, least(1, 1.2 - l_discount * 10)), 3) AS confidence, why AS reason
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN (VALUES {_VALUES}) v(i, raw, why, mapped) ON i = (l_partkey + l_linenumber) % {len(_RAW)})"""


@query("f13_refine_triples", _REFINED + " SELECT c_subject, c_predicate, c_object, reason, count(*) AS n FROM r GROUP BY 1, 2, 3, 4")
def _(t):
    return R.refine(triples(t), aliases(t)).groupBy("c_subject", "c_predicate", "c_object", "reason").agg(F.count("*").alias("n"))


@query("k11_rejection_counts", _REFINED + " SELECT reason, count(*) AS n FROM r WHERE reason <> 'ok' GROUP BY 1")
def _(t):
    return R.rejections(R.refine(triples(t), aliases(t)))


@query("f14_domain_scores", f"SELECT url, CASE WHEN {_any(R.TRUSTED_TLDS, 'h')} THEN 0.9 WHEN h = 'example.net' OR ends_with(h, '.example.net') THEN 0.85 WHEN contains(h, 'th') THEN 0.8 WHEN {_any(R.LOW_TRUST, 'h')} THEN 0.4 ELSE 0.6 END::DOUBLE AS score FROM (SELECT url, {_HOST} AS h FROM pages)")
def _(t):
    h = T.domain_of(F.col("url"))
    return t("pages").select("url", R.domain_score(h, ("example.net",), ("th",)).cast("double").alias("score"))


@query("f15_sensationalism", "SELECT doc_id, CASE WHEN len(w) > 0 THEN round(least(1.0, len(list_filter(w, lambda x: x IN " + _list(R.SENSATIONAL) + ")) / len(w) * 50), 6) ELSE 0 END::DOUBLE AS score FROM (SELECT doc_id, list_filter(string_split_regex(lower(text || CASE WHEN doc_id % 5 = 0 THEN ' shocking!' ELSE '' END), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS w FROM documents)")
def _(t):
    text = F.concat("text", F.when(F.col("doc_id") % 5 == 0, " shocking!").otherwise(""))
    return t("documents").select("doc_id", F.round(R.sensationalism(text), 6).cast("double").alias("score"))


@query("f17_contains_fact", "WITH b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '\\W+'), lambda x: length(x) >= 4) AS w FROM benchmark) SELECT doc_id, item_id FROM (SELECT doc_id, lower(text) AS low FROM documents) d JOIN b ON len(w) > 0 AND 2 * len(list_filter(w, lambda x: contains(low, x))) >= len(w)")
def _(t):
    return R.containing(t("documents"), t("benchmark"))


@query("f18_interceptor", "SELECT page_id, strlen(html) <= 4000 AS small FROM pages")
def _(t):
    return t("pages").select("page_id", (F.octet_length("html") <= 4000).alias("small"))


_MONTHS = "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro".split()


@query(
    "f25_date_like",
    f"""WITH o AS (SELECT o_orderdate AS d, [{", ".join(f"'{m}'" for m in _MONTHS)}][month(o_orderdate)] AS m, o_orderpriority AS p FROM orders),
x AS (SELECT unnest([strftime(d, '%Y'), strftime(d, '%d/%m/%Y'), strftime(d, '%d-%m'), strftime(d, '%Y-%m-%d'), m, day(d) || ' de ' || m || ' de ' || year(d), m || ' ' || year(d), year(d) || ' ' || m, p]) AS t FROM o
  UNION ALL SELECT unnest(string_split_regex(text, '[^\\p{{L}}\\p{{N}}/-]+')) FROM documents)
SELECT t AS text, count(*) AS n, regexp_full_match(t, '[0-9]{{4}}') OR regexp_full_match(t, '[0-9][0-9]?[/-][0-9][0-9]?([/-][0-9]{{2,4}})?') OR regexp_matches(lower(t), '^([0-9][0-9]? (de )?)?({"|".join(_MONTHS)}|january|february|march|april|may|june|july|august|september|october|november|december)( (de )?[0-9]{{4}})?$') AS dated FROM x WHERE t <> '' GROUP BY t""",
)
def _(t):
    """Dates of orders in many shapes, some of which are none, and all words of documents."""
    d, y = F.col("o_orderdate"), F.date_format("o_orderdate", "yyyy")
    m = F.element_at(F.array(*[F.lit(x) for x in _MONTHS]), F.month(d))
    told = [y, *[F.date_format(d, x) for x in ("dd/MM/yyyy", "dd-MM", "yyyy-MM-dd")], m, F.concat(F.day(d), F.lit(" de "), m, F.lit(" de "), y), F.concat(m, F.lit(" "), y), F.concat(y, F.lit(" "), m), F.col("o_orderpriority")]
    words = t("documents").select(F.explode(F.split("text", r"[^\p{L}\p{N}/-]+")).alias("text"))
    seen = t("orders").select(F.explode(F.array(*told)).alias("text")).unionByName(words).filter("text <> ''").groupBy("text").agg(F.count("*").alias("n"))
    return seen.withColumn("dated", R.date_like(F.col("text")))


@query("f23_url_routes", f"SELECT route, count(*) AS n FROM (SELECT CASE WHEN contains(url, '/fr/') THEN 'a' WHEN ends_with({_HOST}, '.example.org') THEN 'b' ELSE 'c' END AS route FROM pages) GROUP BY 1")
def _(t):
    route = F.when(F.contains("url", F.lit("/fr/")), "a").when(T.domain_of(F.col("url")).endswith(".example.org"), "b").otherwise("c")
    return t("pages").groupBy(route.alias("route")).agg(F.count("*").alias("n"))


@query("f22_source_policy", f"WITH d AS (SELECT {_HOST} AS domain, count(*) AS n FROM pages GROUP BY 1), p AS (SELECT *, CASE WHEN ends_with(domain, '.com') THEN 'allowed' WHEN ends_with(domain, '.net') THEN 'warned' ELSE 'unknown' END AS policy FROM d) SELECT policy, count(*) AS domains, CAST(sum(n) AS BIGINT) AS pages FROM p GROUP BY 1")
def _(t):
    d = t("pages").groupBy(T.domain_of(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))
    policy = F.when(F.col("domain").endswith(".com"), "allowed").when(F.col("domain").endswith(".net"), "warned").otherwise("unknown")
    return d.groupBy(policy.alias("policy")).agg(F.count("*").alias("domains"), F.sum("n").alias("pages"))


@query("c14_json_fields", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count("*").alias("n"))


def _facts(t):
    """Customers of a nation and segment as facts with near names: one fact for each triple, with the domains that state it."""
    word = F.element_at(F.array(*[F.lit(x) for x in ("santos fc", "santos futebol clube", "santos f c", "vasco da gama", "vasco gama", "flamengo")]), (F.col("c_nationkey") % 6 + 1).cast("int"))
    won = F.element_at(F.array(*[F.lit(x) for x in ("copa do brasil", "supercopa", "estadual", "mundial", "torneio rio", "libertadores", "taça", "recopa")]), (F.col("c_custkey") % 8 + 1).cast("int"))
    rows = t("customer").select("c_custkey", F.concat(word, F.lit(" "), F.col("c_custkey") % 40).alias("subject"), F.col("c_mktsegment").alias("predicate"), F.concat(won, F.lit(" "), F.col("c_custkey") % 50).alias("object"), F.concat(F.lit("d"), F.col("c_nationkey")).alias("domain"))
    return rows.groupBy("subject", "predicate", "object").agg(F.min("c_custkey").alias("id"), F.array_sort(F.collect_set("domain")).alias("domains"))


@query("a15_near_match_report")
def _(t):
    return U.match_report(U.near_matches(U.near_groups(U.groups(_facts(t)))))


@query("a16_link_candidates")
def _(t):
    return U.link_report(U.groups(_facts(t)))


@query("w07_best_matches")
def _(t):
    facts = _facts(t)
    return U.best_matches(U.near_matches(U.near_groups(U.groups(facts))), facts)


@query("a15_verified_clusters")
def _(t):
    facts = _facts(t)
    return U.verified_clusters(U.near_matches(U.near_groups(U.groups(facts))), facts, 2)


@query("c09_jaccard_pairs", "WITH b AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')) AS w FROM benchmark), p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS u FROM b a JOIN b ON a.item_id < b.item_id) SELECT a, b, i::BIGINT AS shared, u::BIGINT AS either FROM p WHERE i * 7 >= u")
def _(t):
    w = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != ""))
    b = t("benchmark").select("item_id", w.alias("w"))
    # pairs by shared words: an inverted index instead of all pairs
    k = b.select("item_id", F.explode("w").alias("word"), F.size("w").alias("n"))
    p = k.select(F.col("item_id").alias("a"), "word", F.col("n").alias("na")).join(k.select(F.col("item_id").alias("b"), "word", F.col("n").alias("nb")), "word").filter("a < b")
    p = p.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared")).withColumn("either", (F.col("na") + F.col("nb") - F.col("shared")).cast("bigint"))
    return p.filter(F.col("shared") * 7 >= F.col("either")).select("a", "b", "shared", "either")


@query("a22_training_gate", OCC + ", g AS (SELECT count(*) AS records, count(DISTINCT fact_key) AS keys, count(DISTINCT domain) AS domains, 0::BIGINT AS without_source FROM occ), p AS (SELECT max(n) AS top FROM (SELECT count(*) AS n FROM occ GROUP BY predicate)) SELECT records, keys, domains, without_source, round(top / records, 4) AS top_share, 'duplicates' AS blocking, false AS go FROM g, p")
def _(t):
    return U.training_gate(G.with_keys(occurrences(t)).withColumnRenamed("fact_key", "key"))


@query("a23_json_lines", "SELECT count(*) AS lines, count(*) FILTER (v = '') AS blank, count(*) FILTER (v <> '' AND json_valid(v)) AS valid, count(*) FILTER (v <> '' AND NOT json_valid(v)) AS invalid, round(avg(length(v)), 4) AS mean_chars, max(length(v)) AS max_chars FROM (SELECT CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 7 = 0 THEN props || '}' ELSE props END AS v FROM events)")
def _(t):
    v = F.when(F.col("event_id") % 10 == 0, "").when(F.col("event_id") % 7 == 0, F.concat(F.lit("x"), "props", F.lit("}"))).otherwise(F.col("props"))
    v = F.when(F.col("event_id") % 10 == 0, "").when(F.col("event_id") % 7 == 0, F.concat(F.lit("{"), F.substr("props", F.lit(1)))).otherwise(F.col("props"))
    return U.json_lines(t("events").select(v.alias("value")))


@query("a25_page_productivity", f"""WITH d AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages),
x AS (SELECT page_id, {_FLAT.format(x='s')} AS x FROM (SELECT page_id, unnest({_SENT}) AS s FROM d)), w AS (SELECT page_id, {_CANDIDATE} AS why FROM x),
n AS (SELECT d.page_id, url, count(why)::INT AS sentences, (count(*) FILTER (why = 'ok'))::INT AS usable, (count(*) FILTER (why = 'noise_marker'))::INT AS noise FROM d LEFT JOIN w ON w.page_id = d.page_id GROUP BY 1, 2)
SELECT url, sentences, usable, noise, CASE WHEN sentences = 0 THEN 'empty' WHEN noise * 2 > sentences THEN 'navigation_dominated' WHEN usable < 3 THEN 'thin' ELSE 'productive' END AS class FROM n""")
def _(t):
    return U.productivity(t("pages").select("url", T.strip_html(F.col("html")).alias("text")))


@query("a31_parity", """WITH r AS (SELECT user_id % 50 AS target, CASE WHEN event_type IN ('click', 'view') THEN 'a' ELSE 'b' END AS side, json_extract_string(props, '$.k') AS key FROM events),
g AS (SELECT target, list(DISTINCT key) FILTER (side = 'a') AS a, list(DISTINCT key) FILTER (side = 'b') AS b FROM r GROUP BY 1), s AS (SELECT target, coalesce(len(a), 0) AS na, coalesce(len(b), 0) AS nb, len(list_intersect(coalesce(a, []), coalesce(b, []))) AS n FROM g)
SELECT target, na::INT AS a_keys, nb::INT AS b_keys, n::INT AS shared, CASE WHEN na = 0 AND nb = 0 THEN 'nothing_extracted' WHEN (na = 0) <> (nb = 0) THEN 'one_side_empty' WHEN n = 0 THEN 'no_overlap' WHEN na > n OR nb > n THEN 'partial_overlap' ELSE 'parity' END AS cause FROM s""")
def _(t):
    side = F.when(F.col("event_type").isin("click", "view"), "a").otherwise("b")
    return U.parity(t("events").select((F.col("user_id") % 50).alias("target"), side.alias("side"), F.get_json_object("props", "$.k").alias("key")))


@query("a32_forensics", "SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'fetch_failed' WHEN n_chars = 0 THEN 'empty_page' WHEN doc_id % 5 = 0 THEN 'no_sentences' WHEN doc_id % 4 = 0 THEN 'no_triples' WHEN doc_id % 3 = 0 THEN 'all_rejected' WHEN doc_id % 2 = 0 THEN 'not_persisted' ELSE 'ok' END AS stage FROM documents")
def _(t):
    d = F.col("doc_id")
    return t("documents").select("doc_id", U.diagnose(F.when(d % 13 == 0, 404).otherwise(200), F.col("n_chars"), d % 5, d % 4, d % 3, d % 2).alias("stage"))


@query("a33_hygiene", FACTS + ", reg AS (SELECT DISTINCT fact_key FROM occ WHERE confidence > 0.999) SELECT fact_key, array_to_string(list_filter([CASE WHEN reg.fact_key IS NOT NULL THEN 'registered' END, CASE WHEN domains >= 24 THEN 'verified' END, CASE WHEN urls > 45 THEN 'several_urls' END], lambda x: x IS NOT NULL), ',') AS kept_for, reg.fact_key IS NULL AND domains < 24 AND urls <= 45 AS removable FROM facts LEFT JOIN reg USING (fact_key)")
def _(t):
    occ = occurrences(t)
    facts = G.facts(occ, 24).withColumn("urls", F.col("urls") - 44)
    return U.hygiene(facts, G.with_keys(occ.filter("confidence > 0.999")))


@query("a35_dominant_class", "WITH n AS (SELECT user_id % 30 AS u, event_type AS c, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT *, CASE c WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'error' THEN 4 ELSE 999 END AS p FROM n) SELECT u, arg_max(c, row(n, -p)) AS dominant, max(n) AS n FROM p GROUP BY 1")
def _(t):
    return U.dominant(t("events").select((F.col("user_id") % 30).alias("u"), "event_type"), "u", "event_type", {"purchase": 1, "click": 2, "view": 3, "error": 4})


@query("a34_timeline", "SELECT count(*) AS samples, true AS ever, min(event_id) FILTER (event_type = 'purchase') AS first_healthy, true AS errors, 'recovered' AS conclusion FROM events")
def _(t):
    kind = F.when(F.col("event_type") == "purchase", "healthy").when(F.col("event_type") == "error", "error").otherwise("idle")
    return U.timeline(t("events").select(F.col("event_id").alias("at"), kind.alias("class")))


@query("a37_expected_facts", OCC + ", o AS (SELECT fact_key AS key, count(DISTINCT domain) AS domains FROM occ WHERE confidence < 0.905 GROUP BY 1), e AS (SELECT DISTINCT fact_key AS key FROM occ) SELECT key, coalesce(domains, 0) AS domains, CASE WHEN domains IS NULL THEN 'missing' WHEN domains >= 5 THEN 'verified' ELSE 'partial' END AS class FROM e LEFT JOIN o USING (key)")
def _(t):
    occ = G.with_keys(occurrences(t))
    seen = occ.filter("confidence < 0.905").groupBy(F.col("fact_key").alias("key")).agg(F.count_distinct("domain").alias("domains"))
    return U.expected_facts(seen, occ.select(F.col("fact_key").alias("key")).distinct().withColumn("least", F.lit(5)))


@query("j16_compare_metrics", "WITH b AS (SELECT event_type AS name, count(*) AS v FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), a AS (SELECT event_type AS name, count(*) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1) SELECT name, b.v AS before, a.v AS after, coalesce(a.v, 0) - coalesce(b.v, 0) AS delta, coalesce(a.v, 0) < coalesce(b.v, 0) AS regressed FROM b FULL JOIN a USING (name)")
def _(t):
    def part(cond):
        return t("events").filter(cond).groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("value"))

    return U.compare(part("ts < timestamp_ntz'2024-01-16'"), part("ts >= timestamp_ntz'2024-01-16'"))
