"""Tables of HTML as grids: cells that span rows and columns are written out, header rows name columns, captions go with their table.

Parsing a page and placing its cells is a small helper in the tasks; headers, records, profiles and facts are made of grid cells by joins and sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

#: Spans that HTML allows.
MOST_COLUMNS, MOST_ROWS = 1_000, 65_534
#: Cells that a task hands on at once, about; the pages of a batch are put together up to these.
CELLS = 50_000
_CELLS = pa.schema([("id", pa.int64()), ("table", pa.int32()), ("kind", pa.string()), ("caption", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("text", pa.string()), ("header", pa.bool_()), ("own", pa.bool_())])
# fixed values
YEAR_HEADERS = ("ano", "anos", "year", "years", "season", "seasons", "temporada", "temporadas", "edicao", "edicoes", "conquistas")
CLUB_HEADERS = ("clube", "club", "equipe", "team", "time", "campeao", "champion", "winner", "vencedor")
COMPETITION_HEADERS = ("competicao", "competition", "torneio", "tournament", "titulo", "title", "campeonato")


class _Parser(HTMLParser):
    """(kind, caption, rows) of each table and pre block in order of their starts; rows of (text, header, rowspan, colspan). Tables inside cells are tables of their own."""

    def __init__(self):
        super().__init__()
        self.found: list[list] = []
        self.open: list[dict] = []

    def _top(self) -> dict | None:
        return self.open[-1] if self.open else None

    def _end_cell(self) -> None:
        t = self._top()
        if t and t["cell"] is not None:
            text, header, down, across = t["cell"]
            t["rows"][-1].append((" ".join("".join(text).split()), header, down, across))
            t["cell"] = None

    def handle_starttag(self, tag, attrs):
        t = self._top()
        if tag in ("table", "pre"):
            entry = [tag, "", []]
            self.found.append(entry)
            self.open.append({"entry": entry, "rows": entry[2], "cell": None, "caption": None, "text": []})
        elif not t or t["entry"][0] == "pre":
            return
        elif tag == "tr":
            self._end_cell()
            t["rows"].append([])
        elif tag in ("td", "th"):
            self._end_cell()
            if not t["rows"]:
                t["rows"].append([])
            a = dict(attrs)

            def span(name: str, most: int) -> int:
                said = (a.get(name) or "").strip()
                return min(int(said), most) if said.isascii() and said.isdigit() else 1

            t["cell"] = ([], tag == "th", span("rowspan", MOST_ROWS), max(1, span("colspan", MOST_COLUMNS)))
        elif tag == "caption":
            t["caption"] = []
        elif tag == "br" and t["cell"] is not None:
            t["cell"][0].append(" ")

    def handle_data(self, data):
        t = self._top()
        if not t:
            return
        if t["entry"][0] == "pre":
            t["text"].append(data)
        elif t["caption"] is not None:
            t["caption"].append(data)
        elif t["cell"] is not None:
            t["cell"][0].append(data)

    def handle_endtag(self, tag):
        t = self._top()
        if not t:
            return
        if tag in ("td", "th", "tr"):
            self._end_cell()
        elif tag == "caption" and t["caption"] is not None:
            t["entry"][1] = " ".join("".join(t["caption"]).split())
            t["caption"] = None
        elif tag == t["entry"][0]:
            self._end_cell()
            if tag == "pre":
                t["rows"] += [[(x.strip(), False, 1, 1)] for x in "".join(t["text"]).splitlines() if x.strip()]
            self.open.pop()

    def close(self):
        super().close()
        while self.open:
            self.handle_endtag(self.open[-1]["entry"][0])


def placed(rows: list[list[tuple]]) -> list[tuple[int, int, str, bool, bool]]:
    """(row, col, text, header, own) of each cell of the grid; own: where a cell begins, not where it goes on. A cell takes the first free columns of its
    row; a rowspan of 0 and one too long go to the last row; what two cells claim stays with the first."""
    out, taken = [], {}
    for r, row in enumerate(rows):
        c = 0
        for text, header, down, across in row:
            while (r, c) in taken:
                c += 1
            for y in range(r, len(rows) if down == 0 else min(r + down, len(rows))):
                for x in range(c, c + across):
                    if (y, x) not in taken:
                        taken[y, x] = True
                        out.append((y, x, text, header, (y, x) == (r, c)))
            c += across
    return out


def grids(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, table, kind, caption, row, col, text, header, own): the grid cells of all tables and pre blocks, which are numbered in order. Null pages have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = []
            for i, html in zip(b.column("id").to_pylist(), b.column("html").to_pylist(), strict=True):
                p = _Parser()
                p.feed(html or "")
                p.close()
                cells += [(i, n, kind, caption, *cell) for n, (kind, caption, rows) in enumerate(p.found) for cell in placed(rows)]
                if len(cells) >= CELLS:
                    yield _batch(cells)
                    cells = []
            if cells:
                yield _batch(cells)

    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(html_col).alias("html"))
    schema = "id bigint, table int, kind string, caption string, row int, col int, text string, header boolean, own boolean"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _batch(cells: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*cells, strict=True), _CELLS, strict=True)], schema=_CELLS)


def header_rows(cells: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, table, head): the number of rows at the top that hold header cells alone."""
    rows = cells.groupBy(id_col, "table", "row").agg(F.bool_and("header").alias("all"))
    return rows.groupBy(id_col, "table").agg(F.coalesce(F.min(F.when(~F.col("all"), F.col("row"))), F.max("row") + 1).alias("head"))


def _headed(cells: DataFrame, id_col: str) -> DataFrame:
    """cells with head and name, as header_rows and columns give them. The cells of a table are dealt to one task, once, so that pages are parsed once."""
    dealt = cells.filter(F.col(id_col).isNotNull()).repartition(id_col, "table")
    table = Window.partitionBy(id_col, "table")
    out = dealt.withColumn("all", F.bool_and("header").over(Window.partitionBy(id_col, "table", "row")))
    out = out.withColumn("head", F.coalesce(F.min(F.when(~F.col("all"), F.col("row"))).over(table), F.max("row").over(table) + 1)).drop("all")
    said = F.collect_list(F.when(F.col("row") < F.col("head"), F.struct("row", "text"))).over(Window.partitionBy(id_col, "table", "col"))
    out = out.withColumn("name", F.transform(F.array_sort(said), lambda x: x["text"]))
    out = out.withColumn("name", F.array_join(F.array_distinct(F.filter("name", lambda x: x != "")), " "))
    return out.withColumn("name", F.when(F.col("name") != "", F.col("name")).otherwise(F.concat(F.lit("col"), F.col("col") + 1)))


def columns(cells: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, table, col, name): what the header rows say of a column, one after the other, each text once; columns without header are named col1, col2 ..."""
    return _headed(cells, id_col).select(id_col, "table", "col", "name").distinct()


def records(cells: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, table, caption, row, fields): the rows below the headers as (name, text) in order of columns; rows without any text are left out."""
    body = _headed(cells, id_col).filter("row >= head")
    fields = F.array_sort(F.collect_list(F.struct("col", "name", "text")))
    out = body.groupBy(id_col, "table", "caption", "row").agg(fields.alias("f")).filter(F.exists("f", lambda x: x["text"] != ""))
    return out.select(id_col, "table", "caption", "row", F.transform("f", lambda x: F.struct(x["name"].alias("name"), x["text"].alias("text"))).alias("fields"))


def profiles(cells: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, table, kind, caption, rows, cols, head, spans, empty): what each table is like; spans counts grid cells that a cell goes on into."""
    per = cells.groupBy(id_col, "table", "kind", "caption").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"), F.count_if(~F.col("own")).alias("spans"), F.count_if(F.col("text") == "").alias("empty"))
    return per.join(header_rows(cells, id_col), [id_col, "table"]).select(id_col, "table", "kind", "caption", "rows", "cols", "head", "spans", "empty")


def target_rows(cells: DataFrame, targets: DataFrame, id_col: str = "page_id", longest: int = 600) -> DataFrame:
    """(id, table, row, target): rows whose cells together hold a target's subject and object (targets: target, subject, object), folded; rows over
    `longest` characters are lists, not facts."""
    from .containment import contained

    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]), " | ")
    rows = cells.filter("own").groupBy(id_col, "table", "row").agg(T.fold_span(joined).alias("said")).filter(F.length("said").between(1, longest))
    wanted = targets.select("target", T.fold_span(F.col("subject")).alias("__s"), T.fold_span(F.col("object")).alias("__o")).filter("__s <> '' and __o <> ''").distinct()
    hit = contained(rows, [id_col, "table", "row"], "said", wanted, "__s").filter(F.contains("said", F.col("__o")))
    return hit.select(id_col, "table", "row", "target").distinct()


def _named(fields, names: tuple[str, ...]):
    """Texts of the columns one of whose words is in names, in order."""
    return F.transform(F.filter(fields, lambda x: F.arrays_overlap(F.split(T.fold_span(x["name"]), " "), F.array(*[F.lit(n) for n in names]))), lambda x: x["text"])


def honours(rows: DataFrame, allowed: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, subject, VENCEU, object, year) of records(): club, competition and years by what the headers say, the competition also by the caption,
    for allowed (club, competition); a row for each year, one of null year where none is told."""
    club, competition = F.get(_named("fields", CLUB_HEADERS), F.lit(0)), F.get(_named("fields", COMPETITION_HEADERS), F.lit(0))
    years = F.regexp_extract_all(F.array_join(_named("fields", YEAR_HEADERS), " "), F.lit(r"\b([12][0-9]{3})\b"), F.lit(1))
    told = rows.select(id_col, T.fold_key(club).alias("c"), T.fold_key(F.coalesce(competition, F.col("caption"))).alias("t"), F.explode_outer(F.array_distinct(years)).alias("year"))
    known = allowed.select(T.fold_key(F.col("club")).alias("c"), T.fold_key(F.col("competition")).alias("t"), F.col("club").alias("subject"), F.col("competition").alias("object"))
    out = told.filter("c <> ''").join(known, ["c", "t"])
    return out.select(id_col, "subject", F.lit("VENCEU").alias("predicate"), "object", F.col("year").cast("int").alias("year")).distinct()
