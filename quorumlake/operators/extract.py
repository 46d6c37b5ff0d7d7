"""Triples from text, tables and geographic records."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.vocabulary import predicate_forms
from .containment import contained
from .refine import map_predicate

# fixed values
VERBS = ("utiliza", "utilizam", "usa", "usam", "emprega", "executa", "produz", "gera", "cria", "conecta", "pertence", "contém", "inclui", "define", "aprende", "possui", "deriva", "influencia", "é", "são")


def svo(rows: DataFrame, verbs: tuple[str, ...] = VERBS, most: int = 10, id_col: str = "doc_id") -> DataFrame:
    """(id, pos, subject, predicate, object): a few words before and after a verb of the list, the first `most` of a text."""
    words = r"[\p{L}\p{N}-]+"
    pattern = rf"(?i)((?:{words} ){{1,4}})({'|'.join(verbs)}) ((?:{words} ?){{1,4}})"
    # a match starts at a word, so other places need not be tried
    found = F.regexp_extract_all(F.col("text"), F.lit(rf"(?i)(?<![\p{{L}}\p{{N}}-]){pattern[4:]}"), F.lit(0))
    out = rows.select(id_col, F.posexplode(F.slice(found, 1, most)).alias("pos", "m"))
    part = [F.trim(F.regexp_extract("m", pattern, i)) for i in (1, 2, 3)]
    return out.select(id_col, "pos", part[0].alias("subject"), map_predicate(part[1]).alias("predicate"), part[2].alias("object"))


def trie_pattern(forms: list[str]) -> str:
    """A regular expression of the forms with common beginnings written once, the longest form that fits first. Words of a form stand two spaces apart."""
    trie: dict = {}
    for form in forms:
        node = trie
        for ch in form.replace(" ", "  "):
            node = node.setdefault(ch, {})
        node[""] = {}

    def said(node: dict) -> str:
        ways = [re.escape(ch) + said(below) for ch, below in node.items() if ch]
        if not ways:
            return ""
        body = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})"
        return f"{body}?" if "" in node else body

    return said(trie)


def verb_triples(rows: DataFrame, forms: dict[str, str] | None = None, reach: int = 6, id_col: str = "doc_id") -> DataFrame:
    """(id, clause, pos, subject, predicate, object): every verb form of a clause, with up to `reach` words on either side as far as the next one.

    forms: folded form, of one or several words -> predicate (without: the controlled forms). At each word the longest form counts. Clauses
    end at punctuation, brackets and line ends; spans keep the spelling of the text. Verbs with no word on one side make no triple.
    """
    table = predicate_forms() if forms is None else forms
    clauses = rows.select(id_col, F.posexplode(F.split("text", r"[.;,:!?()\[\]\n\r]+")).alias("clause", "c"))
    words = clauses.select(id_col, "clause", F.regexp_extract_all("c", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w")).filter("size(w) > 2")
    folded = F.array_join(F.transform("w", lambda x: F.concat(F.lit(" "), F.regexp_replace(T.unaccent(x), "[^a-z0-9]", "_"), F.lit(" "))), "")
    # every word stands between spaces of its own, so that a form takes whole words
    marked = words.withColumn("m", F.regexp_replace(folded, f" ({trie_pattern(list(table))}) ", "\u0001$1\u0002")).filter(F.contains("m", F.lit("\u0001")))
    parts = marked.withColumn("m", F.split("m", "[\u0001\u0002]")).withColumn("n", F.transform("m", lambda x: F.size(F.filter(F.split(x, " "), lambda y: y != ""))))

    def verb(j: Column) -> Column:
        at = F.aggregate(F.slice("n", 1, 2 * j - 1), F.lit(0), lambda a, x: a + x)
        before, after = F.least(F.get("n", 2 * j - 2), F.lit(reach)), F.least(F.get("n", 2 * j), F.lit(reach))
        return F.struct(
            F.array_join(F.slice("w", at - before + 1, before), " ").alias("subject"), F.replace(F.get("m", 2 * j - 1), F.lit("  "), F.lit(" ")).alias("verb"),
            F.array_join(F.slice("w", at + F.get("n", 2 * j - 1) + 1, after), " ").alias("object"),
        )

    found = parts.select(id_col, "clause", F.posexplode(F.transform(F.sequence(F.lit(1), F.floor((F.size("m") - 1) / 2).cast("int")), verb)).alias("pos", "t"))
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = found.filter("t.subject <> '' and t.object <> ''")
    # few forms, many verbs: looked up once each
    named = found.select(F.col("t.verb").alias("verb")).distinct().withColumn("predicate", F.try_element_at(known, F.col("verb")))
    return found.select(id_col, "clause", "pos", "t.*").join(named, "verb").select(id_col, "clause", "pos", "subject", "predicate", "object")


def confidence(subject: Column, predicate: Column, object_: Column) -> Column:
    """0.5, 0.15 more for each of a short subject, a short object and a known predicate; 0.99 at most."""
    short = [F.when(F.size(F.split(F.trim(c), r"\s+")) <= 4, 0.15).otherwise(0.0) for c in (subject, object_)]
    return F.round(F.least(F.lit(0.99), 0.5 + short[0] + short[1] + F.when(predicate.isNotNull(), 0.15).otherwise(0.0)), 2)


def nominal(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sentences of the frames `X é um Y` and `X, Y, ...` (apposition): (id, subject, SER, object)."""
    x = F.col("text")
    copula = r"^(\p{Lu}[\p{L}\p{N} -]{1,40}?) (?:é|foi|is|was) (?:um|uma|o|a|an|the) ([\p{L}\p{N} -]{2,40})"
    apposition = r"^(\p{Lu}[\p{L}\p{N} -]{1,40}?), (?:um|uma|o|a|an|the) ([\p{L}\p{N} -]{2,40}),"
    s = F.when(x.rlike(copula), F.regexp_extract(x, copula, 1)).when(x.rlike(apposition), F.regexp_extract(x, apposition, 1))
    o = F.when(x.rlike(copula), F.regexp_extract(x, copula, 2)).when(x.rlike(apposition), F.regexp_extract(x, apposition, 2))
    return rows.select(id_col, s.alias("subject"), F.lit("SER").alias("predicate"), F.trim(o).alias("object")).filter("subject is not null")


def targets_first(rows: DataFrame, is_target: Column, key: str, order: str, most: int = 25) -> DataFrame:
    """The first `most` rows of a key, those that are targets before the others."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(is_target.cast("int")), order))
    return rows.withColumn("__r", place).filter(F.col("__r") <= most).drop("__r")


def merge_bands(primary: DataFrame, fallback: DataFrame, key: str, enough: int = 10, most: int = 25) -> DataFrame:
    """Triples of a key from the primary extractor alone if they are enough; else fallback ones join, duplicates by case go, up to `most`."""
    n = primary.groupBy(key).agg(F.count("*").alias("__n"))
    extra = fallback.join(n.filter(F.col("__n") >= enough), key, "left_anti")
    rows = primary.withColumn("__band", F.lit(1)).unionByName(extra.withColumn("__band", F.lit(0)))
    same = [F.lower(c) for c in ("subject", "predicate", "object")]
    first = F.row_number().over(Window.partitionBy(key, *same).orderBy("__band", "pos"))
    rows = rows.withColumn("__d", first).filter("__d = 1")
    place = F.row_number().over(Window.partitionBy(key).orderBy("__band", "pos", *same))
    return rows.withColumn("__r", place).filter(F.col("__r") <= most).drop("__r", "__d", "__band")


def winners(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lines of plain tables, `year  club`: (id, pos, year, club, reason), ok or runner_up, score, unmatched."""
    x = F.trim("line")
    row = r"^([12][0-9]{3})(?:/[0-9]{2})?[ :.-]+(\p{L}[\p{L} .'-]+?)(?: *\(.*\))?$"
    why = F.when(F.lower(x).rlike("vice|runner|2nd"), "runner_up").when(x.rlike(r"\b[0-9]+ ?[x-] ?[0-9]+\b"), "score").when(~x.rlike(row), "unmatched").otherwise("ok")
    ok = why == "ok"
    return lines.select(id_col, "pos", F.when(ok, F.regexp_extract(x, row, 1).cast("int")).alias("year"), F.when(ok, F.regexp_extract(x, row, 2)).alias("club"), why.alias("reason"))


def table_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, table, row, cells, css) of every table of HTML, cells as text, css the table's classes; by the standard parser, in Arrow batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from html.parser import HTMLParser

        class Tables(HTMLParser):
            def __init__(self):
                super().__init__()
                self.rows, self.table, self.css, self.cells, self.cell = [], -1, "", None, None

            def handle_starttag(self, tag, attrs):
                if tag == "table":
                    self.table += 1
                    self.css = dict(attrs).get("class") or ""
                elif tag == "tr":
                    self.cells = []
                elif tag in ("td", "th") and self.cells is not None:
                    self.cell = []

            def handle_data(self, data):
                if self.cell is not None:
                    self.cell.append(data)

            def handle_endtag(self, tag):
                if tag in ("td", "th") and self.cell is not None and self.cells is not None:
                    self.cells.append(" ".join("".join(self.cell).split()))
                    self.cell = None
                elif tag == "tr" and self.cells is not None:
                    self.rows.append((self.table, self.cells, self.css))
                    self.cells = None

        for pdf in parts:
            out = []
            for i, html in zip(pdf["id"], pdf["html"], strict=True):
                p = Tables()
                p.feed(html or "")
                out += [(i, t, n, c, css) for n, (t, c, css) in enumerate(p.rows)]
            yield pd.DataFrame(out, columns=["id", "table", "row", "cells", "css"])

    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(html_col).alias("html"))
    return rows.mapInPandas(run, "id bigint, table int, row int, cells array<string>, css string").withColumnRenamed("id", id_col)


def honours(rows: DataFrame, allowed: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Table rows of club, competition and years as (id, subject, VENCEU, object, year), one a year, for allowed (club, competition)."""
    cells = rows.filter(F.size("cells") >= 3).select(id_col, F.col("cells")[0].alias("club"), F.col("cells")[1].alias("competition"), F.explode(F.regexp_extract_all(F.col("cells")[2], F.lit(r"\b([12][0-9]{3})\b"), F.lit(1))).alias("year"))
    known = allowed.select(T.fold_key(F.col("club")).alias("k1"), T.fold_key(F.col("competition")).alias("k2"), F.col("club").alias("subject"), F.col("competition").alias("object"))
    hit = (T.fold_key(F.col("club")) == F.col("k1")) & (T.fold_key(F.col("competition")) == F.col("k2"))
    return cells.join(known, hit).select(id_col, "subject", F.lit("VENCEU").alias("predicate"), "object", F.col("year").cast("int"))


def geo_cities(entries: DataFrame, stadiums: DataFrame) -> DataFrame:
    """Entries (json) of map records as (stadium, LOCALIZADO_EM, city): by alias (alias, stadium), only where one city is named.

    Records of streets and offices are passed over; a record whose name fits several stadiums counts for none.
    """
    schema = "place_id bigint, name string, class string, type string, address map<string,string>"
    rows = entries.select(F.from_json("json", schema).alias("j")).select("j.*").filter(~F.coalesce(F.col("class"), F.lit("")).isin("highway", "office", "railway"))
    city = F.coalesce(F.col("address")["city"], F.col("address")["town"], F.col("address")["municipality"])
    rows = rows.select("place_id", T.fold_key(F.col("name")).alias("n"), city.alias("city")).filter("city is not null")
    named = stadiums.select("stadium", T.fold_key(F.col("alias")).alias("__alias"))
    hit = contained(rows, ["place_id", "n"], "n", named, "__alias")
    one = hit.groupBy("place_id", "city").agg(F.count_distinct("stadium").alias("k"), F.min("stadium").alias("stadium")).filter("k = 1")
    out = one.groupBy("stadium").agg(F.count_distinct(T.fold_key(F.col("city"))).alias("k"), F.min("city").alias("city")).filter("k = 1")
    return out.select(F.col("stadium").alias("subject"), F.lit("LOCALIZADO_EM").alias("predicate"), F.col("city").alias("object"))


def located(rows: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The city of a page: from an infobox (0.95), else from the first sentence that tells a location (0.9)."""
    box = r"(?is)<th[^>]*>\s*(?:local|location|city|cidade)\s*</th>\s*<td[^>]*>(.*?)</td>"
    infobox = F.trim(F.regexp_replace(F.regexp_extract("html", box, 1), "<[^>]+>", ""))
    told = F.regexp_extract(T.strip_html(F.col("html")), r"(?:located in|fica em|localizado em|localizada em|situado em) (\p{Lu}[\p{L} -]+)", 1)
    return rows.select(id_col, F.when(infobox != "", infobox).when(told != "", F.trim(told)).alias("city"), F.when(infobox != "", 0.95).when(told != "", 0.9).alias("confidence")).filter("city is not null")


def cooccurrences(rows: DataFrame, first: DataFrame, second: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sentences that name an entity of each list (name), of which there may be any number: (id, a, b, sentences)."""
    s = rows.select(id_col, F.posexplode(T.sentences(F.col("text"))).alias("n", "s")).withColumn("k", T.fold_span(F.col("s")))
    a = first.select(F.col("name").alias("a"), T.fold_span(F.col("name")).alias("__a"))
    b = second.select(F.col("name").alias("b"), T.fold_span(F.col("name")).alias("__b"))
    hit = contained(contained(s, [id_col, "n"], "k", a, "__a"), [id_col, "n", "a"], "k", b, "__b")
    return hit.groupBy(id_col, "a", "b").agg(F.count("*").alias("sentences"))


def target_match(text: Column, any_subject: tuple[str, ...], any_object: tuple[str, ...]) -> Column:
    """Whether a folded text has one of the subject terms and one of the object terms."""
    k = T.fold_span(text)

    def some(terms: tuple[str, ...]) -> Column:
        return F.exists(F.array(*[F.lit(x) for x in terms]), lambda x: F.contains(k, x))

    return some(any_subject) & some(any_object)


def payloads(triples: DataFrame, by: str = "url") -> DataFrame:
    """Triples collected per source, in order: (by, n, entities). A source's triples are bounded by its text."""
    return triples.groupBy(by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("subject", "predicate", "object"))).alias("entities"))
