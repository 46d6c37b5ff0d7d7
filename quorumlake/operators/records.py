"""Records of fixed layouts: honours and player tables, places told in articles, bulk exports, map answers, and the state of expected facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .containment import contained

# fixed values
YEAR = r"\b(19[0-9]{2}|20[0-9]{2})\b"
YEAR_RANGE = r"\b(19|20)[0-9]{2}\s*[–—-]\s*(19|20)[0-9]{2}"
SECTIONS = ("continental", "national", "inter-state", "state", "mundiais", "internacionais", "nacionais")
NAVIGATION_TABLES = ("navbox", "nowraplinks", "hlist", "collapsible")
PLACE_PHRASES = (
    "cidade do",
    "cidade de",
    "cidade da",
    "municipio de",
    "localizado em",
    "localizada em",
    "situado em",
    "fica em",
    "located in the city of",
    "located in",
    "is situated in",
)
FORBIDDEN_KINDS = (
    "CIDADE", "ESTADIO", "BAIRRO", "PAIS", "ESTADO", "ENDERECO", "COORDENADA", "CLAUSULA", "GENERICO", "SELECAO_AMBIGUA", "COMPETICAO",
    "EMPRESTIMO_NAO_SUPORTADO", "BASE_JUVENTUDE_NAO_SUPORTADA",
)
DOMAIN_VERBS = (
    "defendeu", "defender", "jogou", "jogar", "disputou", "disputar", "venceu", "vencer", "contratou", "contratar", "conquistou", "conquistar",
    "representou", "representar", "atuou", "atuar", "liderou", "liderar", "played", "scored", "won", "joined", "captained",
)


def season_honours(rows: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, table, row, competition, year, reason) of table rows (table_rows): one row for each year won, or one with the reason why there is none.

    Tables that name no competition and navigation boxes give `not_honours` and `navigation`. In tables of participations ("melhor
    campanha") the years of the cells of titles count, elsewhere those of the cell with most years (ties: the first).
    """
    cells = F.filter("cells", lambda c: c != "")
    x = rows.withColumn("cells", cells).withColumn("low", F.lower(F.array_join("cells", " | ")))
    table = Window.partitionBy(id_col, "table")
    has = [F.max(F.contains(T.fold_span(F.col("low")), F.lit(word))).over(table) for word in ("competi", "melhor campanha")]
    x = x.withColumn("honours", has[0]).withColumn("parts", has[1]).filter(F.size("cells") >= 2)

    def years(c: Column) -> Column:
        return F.regexp_extract_all(c, F.lit(YEAR), F.lit(1))

    later = F.slice("cells", 2, 1_000_000)
    most = F.array_max(F.transform(later, lambda c: F.size(years(c))))
    titles = F.filter("cells", lambda c: F.contains(F.lower(c), F.lit("campe")))
    told = F.when(F.col("parts"), F.array_join(titles, " | ")).otherwise(F.get(F.filter(later, lambda c: F.size(years(c)) == F.col("most")), F.lit(0)))
    x = x.withColumn("most", most).withColumn("told", told).withColumn("years", years(F.col("told")))
    css = F.lower(F.coalesce("css", F.lit("")))
    why = (
        F.when(css.rlike("|".join(NAVIGATION_TABLES)), "navigation")
        .when(~F.col("honours"), "not_honours")
        .when(F.col("low").rlike(rf"^({'|'.join(SECTIONS)})\b"), "section")
        .when(F.col("low").rlike("vice|runner"), "runner_up")
        .when(F.col("parts") & (F.size(titles) == 0), "no_title")
        .when(F.col("told").rlike(YEAR_RANGE), "range")
        .when(F.size("years") == 0, "no_years")
        .otherwise("ok")
    )
    x = x.withColumn("reason", why)
    name = F.trim(F.regexp_replace(F.col("cells")[0], r"\[[0-9]+\]", ""))
    won = F.when(F.col("reason") == "ok", F.transform("years", lambda y: y.cast("int")))
    return x.select(id_col, "table", "row", F.when(F.col("reason") == "ok", name).alias("competition"), F.explode_outer(won).alias("year"), "reason")


def player_clubs(pages: DataFrame, players: DataFrame, clubs: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, pos, subject, predicate, object, reason) of `NAME (n jogos ... como jogador do CLUB)` in the text of a page's pre blocks, or of all of it without
    such. Names count that are in players and clubs (name): unknown_player, unknown_club or ok."""
    pre = F.array_join(F.regexp_extract_all("html", F.lit(r"(?is)<pre[^>]*>(.*?)</pre>"), F.lit(1)), "\n")
    text = F.regexp_replace(F.when(pre != "", pre).otherwise(F.coalesce("html", F.lit(""))), "<[^>]+>", "")
    shape = r"([^\n()]{1,45}?)\s*\(\s*[0-9]+ jogos[^)]*?como jogador d[oa] ([^)]+)\)"
    found = pages.select(id_col, F.posexplode(F.regexp_extract_all(text, F.lit(shape), F.lit(0))).alias("pos", "m"))
    named = [F.upper(F.trim(F.regexp_extract("m", shape, i))) for i in (1, 2)]
    found = found.select(id_col, "pos", named[0].alias("subject"), named[1].alias("object"))
    for side, known in (("subject", players), ("object", clubs)):
        names = known.select(F.upper("name").alias(f"__{side}")).distinct()
        found = found.join(names, F.col(side) == F.col(f"__{side}"), "left")
    why = F.when(F.col("__subject").isNull(), "unknown_player").when(F.col("__object").isNull(), "unknown_club").otherwise("ok")
    return found.select(id_col, "pos", "subject", F.lit("DEFENDEU").alias("predicate"), "object", why.alias("reason"))


def told_places(pages: DataFrame, stadiums: DataFrame, cities: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, subject, LOCALIZADO_EM, object) of articles that name one stadium (alias, stadium), by the first phrase of location whose place is a known city (city)."""
    text = T.strip_html(F.col("html"))
    x = pages.select(id_col, T.fold_span(text).alias("folded"), F.lower(T.unaccent(text)).alias("low"))
    hit = contained(x, [id_col], "folded", stadiums.select("stadium", T.fold_span(F.col("alias")).alias("__alias")), "__alias")
    one = hit.groupBy(id_col).agg(F.count_distinct("stadium").alias("k"), F.min("stadium").alias("subject"), F.first("low").alias("low")).filter("k = 1")
    places = F.array(*[F.regexp_extract("low", rf"\b{p} ([a-z'`\- ]{{3,40}})", 1) for p in PLACE_PHRASES])
    one = one.select(id_col, "subject", F.posexplode(places).alias("pos", "place"))
    place = T.fold_span(F.element_at(F.split("place", " by | where | which "), 1))
    known = cities.select(T.fold_span(F.col("city")).alias("__k"), F.col("city").alias("object")).distinct()
    best = one.join(known, place == F.col("__k")).groupBy(id_col, "subject").agg(F.min_by("object", F.struct("pos", "object")).alias("object"))
    return best.select(id_col, "subject", F.lit("LOCALIZADO_EM").alias("predicate"), "object")


def domain_verbs(c: Column, verbs: tuple[str, ...] = DOMAIN_VERBS) -> Column:
    """The verbs of a list that are words of a text, folded, in order of the alphabet."""
    return F.array_sort(F.array_intersect(F.split(T.fold_span(c), " "), F.array(*[F.lit(v) for v in verbs])))


def item_payloads(bindings: DataFrame, predicate: str, title: str, confidence: float = 0.95) -> DataFrame:
    """Bulk query answers (item url, label, value) as one payload an item: (item, title, n, entities), values in order.

    Labels and values are trimmed and in upper case; rows without one, or of a value that is the label, go. The label is the first in order.
    """
    item = F.element_at(F.split("item", "/"), -1)
    rows = bindings.select(item.alias("item"), F.upper(F.trim("label")).alias("label"), F.upper(F.trim("value")).alias("value"))
    rows = rows.filter("item <> '' AND label <> '' AND value <> '' AND label <> value")
    triple = F.struct(F.col("label").alias("subject"), F.lit(predicate).alias("predicate"), F.col("value").alias("object"), F.lit(confidence).alias("confidence"))
    grouped = rows.groupBy("item").agg(F.min("label").alias("label"), F.count("*").alias("n"), F.array_sort(F.collect_list(triple)).alias("entities"))
    return grouped.select("item", F.concat(F.lit(f"{title}: "), "label").alias("title"), "n", "entities")


def json_answers(fetched: DataFrame, host: str, most: int = 2_000_000) -> DataFrame:
    """fetched (url, content_type, body) with `reason`, and `records`, the answer's objects as JSON strings where it is ok.

    Only https answers of one host that were asked for as JSON, are JSON and have at most `most` bytes count.
    """
    url, body = F.col("url"), F.coalesce("body", F.lit(""))
    https = (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & (F.lower(F.try_parse_url(url, F.lit("AUTHORITY"))) == host)
    asked = F.contains(F.lower(F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit("format")), F.lit(""))), F.lit("json"))
    many, one = F.from_json(body, "array<variant>"), F.from_json(body, "variant")
    listed = F.when(F.ltrim(body).startswith("["), F.transform(many, lambda v: F.to_json(v))).when(F.ltrim(body).startswith("{"), F.array(F.to_json(one)))
    why = (
        F.when(~F.coalesce(https, F.lit(False)), "host")
        .when(~asked, "format")
        .when(~F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("application/json")), "content_type")
        .when(F.octet_length(body) > most, "size")
        .otherwise("ok")
    )
    return fetched.withColumn("reason", why).withColumn("records", F.when(why == "ok", F.coalesce(listed, F.array().cast("array<string>"))))


def decode_by_marker(c: Column, markers: tuple[str, ...]) -> Column:
    """Bytes as text: UTF-8 (without its mark), UTF-16, UTF-16LE or Latin-1, the first in which a marker is seen, else Latin-1."""
    utf8 = F.regexp_replace(F.try_validate_utf8(c.cast("string")), "^﻿", "")
    # a decoder may fail on bytes of another encoding: only an even number of them is UTF-16
    even = F.octet_length(c) % 2 == 0
    wide = [F.when(even & F.hex(c).rlike("^(FFFE|FEFF)"), F.decode(c, "UTF-16")), F.when(even & F.hex(c).rlike("^(..00)"), F.decode(c, "UTF-16LE"))]

    def marked(x: Column) -> Column:
        return F.when(x.rlike("|".join(markers)), x)

    return F.coalesce(marked(utf8), *[marked(x) for x in wide], F.decode(c, "ISO-8859-1"))


def _variants(expected: DataFrame, column: str, out: str) -> DataFrame:
    return expected.select("candidate_id", F.explode(column).alias("v")).select("candidate_id", T.fold_key(F.col("v")).alias(out)).distinct()


def pilot_validation(expected: DataFrame, rows: DataFrame, same_family: tuple[str, ...] = (), quorum: int = 3) -> DataFrame:
    """Whether expected facts (candidate_id, subjects, objects: lists of variants) are among rows (subject, object, verified, domain), one row a fact and domain.

    Accents, case and articles don't matter. The domains of verified facts count where there are any, else those of all:
    (candidate_id, present, verified, domain_count, outside, meets_quorum, status); outside: a domain not of same_family.
    """
    wanted = _variants(expected, "subjects", "s").join(_variants(expected, "objects", "o"), "candidate_id")
    seen = rows.select(T.fold_key(F.col("subject")).alias("s"), T.fold_key(F.col("object")).alias("o"), F.coalesce("verified", F.lit(False)).alias("verified"), "domain").distinct()
    found = wanted.join(seen, ["s", "o"]).groupBy("candidate_id").agg(
        F.max("verified").alias("verified"),
        F.collect_set(F.when(F.col("verified"), F.col("domain"))).alias("good"),
        F.collect_set("domain").alias("every"),
    )
    found = found.withColumn("domains", F.when(F.col("verified"), F.col("good")).otherwise(F.col("every")))
    out = expected.select("candidate_id").distinct().join(found, "candidate_id", "left")
    domains = F.coalesce("domains", F.array().cast("array<string>"))
    present, verified = F.col("every").isNotNull(), F.coalesce("verified", F.lit(False))
    status = F.when(verified, "verified").when(present, "partial").otherwise("missing")
    outside = F.exists(domains, lambda d: ~d.isin(*same_family)) if same_family else F.size(domains) > 0
    return out.select("candidate_id", present.alias("present"), verified.alias("verified"), F.size(domains).alias("domain_count"), outside.alias("outside"), (F.size(domains) >= quorum).alias("meets_quorum"), status.alias("status"))


def fact_states(expected: DataFrame, rows: DataFrame, predicate: str, allowed: tuple[str, ...], same_family: tuple[str, ...] = ()) -> DataFrame:
    """The state of each expected fact (candidate_id, subjects, objects) in rows (fact_id, subject, predicate, object, verified, domain).

    Objects that go on behind a variant are broken spans; those of a forbidden kind or of one word are junk: either blocks. A
    predicate of the subject that isn't allowed is only noted. (candidate_id, facts, verified, domain_count, outside, span_broken, junk_object,
    forbidden_object, invalid_predicate, blocked)
    """
    key = T.fold_key(F.col("object"))
    seen = rows.withColumn("s", T.fold_key(F.col("subject"))).withColumn("key", key)
    told = _variants(expected, "subjects", "s").join(expected.select("candidate_id", F.transform("objects", T.fold_key).alias("names")), "candidate_id").join(seen, "s", "left")
    same = F.array_contains("names", F.col("key"))
    exact = (F.col("predicate") == predicate) & (same | F.exists("names", lambda n: F.col("key").startswith(F.concat(n, F.lit(" ")))))
    forbidden = (F.col("key") == "") | F.upper(F.element_at(F.split("key", " "), 1)).isin(*FORBIDDEN_KINDS)
    junk = forbidden | (F.size(F.split("key", " ")) < 2)

    def some(c: Column) -> Column:
        return F.coalesce(F.max(F.coalesce(c, F.lit(False))), F.lit(False))

    other = (F.trim("predicate") != "") & ~F.upper(F.trim("predicate")).isin(*allowed)
    out = told.groupBy("candidate_id").agg(
        F.count_distinct(F.when(exact, F.col("fact_id"))).alias("facts"),
        some(exact & F.col("verified")).alias("verified"),
        F.count_distinct(F.when(exact, F.col("domain"))).alias("domain_count"),
        some(exact & ~F.col("domain").isin(*same_family)).alias("outside") if same_family else some(exact).alias("outside"),
        some(exact & ~same).alias("span_broken"),
        some(exact & junk).alias("junk_object"),
        some(exact & forbidden).alias("forbidden_object"),
        some(other).alias("invalid_predicate"),
    )
    return out.withColumn("blocked", F.col("span_broken") | F.col("junk_object") | F.col("forbidden_object"))


def risk_matrix(selected: DataFrame, evidence: DataFrame, warned: str = "") -> DataFrame:
    """selected (candidate_id, risk, required_domains, risks) with evidence (candidate_id, strength) and a warning added where a required domain holds `warned`."""
    warn = F.exists("required_domains", lambda d: F.contains(d, F.lit(warned))) & F.lit(warned != "")
    risks = F.concat(F.coalesce("risks", F.array().cast("array<string>")), F.when(warn, F.array(F.lit("same_family_warning"))).otherwise(F.array().cast("array<string>")))
    return selected.withColumn("risks", risks).join(evidence, "candidate_id", "left").withColumn("strength", F.coalesce("strength", F.lit("none")))


def dry_run(matrix: DataFrame, least: int, most: int, records: int) -> DataFrame:
    """One row on a risk matrix: how many of each risk and strength, the records that would be reached, and whether the run may start: between
    `least` and `most` candidates, all of them with read or stored evidence, none of high risk."""
    strong = F.col("strength").isin("read", "stored")
    out = matrix.agg(
        F.count("*").alias("selected"),
        *[F.count_if(F.col("risk") == r).alias(f"{r}_risk") for r in ("low", "medium", "high")],
        *[F.count_if(F.col("strength") == s).alias(f"evidence_{s}") for s in ("read", "stored", "none")],
        F.count_if(F.exists("risks", lambda r: r == "same_family_warning")).alias("warned"),
        F.count_if(~strong).alias("weak"),
    )
    ready = F.col("selected").between(least, most) & (F.col("weak") == 0) & (F.col("high_risk") == 0)
    return out.withColumn("predicted_records", F.col("selected") + records).withColumn("ready", ready).drop("weak")
