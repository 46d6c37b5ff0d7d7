"""Grids of HTML tables: spans, headers, captions, nested tables, and what is read off them."""

import random

from quorumlake.operators import tables as B


def page(spark, *htmls):
    return spark.createDataFrame([(i, h, "x") for i, h in enumerate(htmls)], "page_id bigint, html string, text string")


def test_spans_headers_and_captions(spark):
    html = """<table><caption> Copa  do Brasil </caption><tr><th rowspan=2>Clube</th><th colspan=2>Títulos</th></tr><tr><th>Anos</th><th>N</th></tr>
<tr><td rowspan="2">Santos</td><td>1962, 1963<td>2</tr><tr><td>1968</td><td></td></tr><tr><td colspan=3> </td></tr><tr><td>Vasco</td><td>s/d</td><td>0</td></tr></table>
<table><tr><td>a<table><tr><td>inner</td></tr></table>b</td></tr></table><pre>1962 Santos
 1970 Vasco</pre>"""
    cells = B.grids(page(spark, html, None, "", "<p>no table</p>", "<tr><td>stray"))
    rows = {(r.table, r.row): [(f.name, f.text) for f in r.fields] for r in B.records(cells).collect()}
    head = ["Clube", "Títulos Anos", "Títulos N"]
    assert rows[0, 2] == list(zip(head, ["Santos", "1962, 1963", "2"], strict=True))
    assert rows[0, 3] == list(zip(head, ["Santos", "1968", ""], strict=True))
    assert (0, 4) not in rows and rows[0, 5][0] == ("Clube", "Vasco")
    assert rows[1, 0] == [("col1", "ab")] and rows[2, 0] == [("col1", "inner")]
    assert rows[3, 1] == [("col1", "1970 Vasco")]
    allowed = spark.createDataFrame([("Santos", "Copa do Brasil"), ("Vasco", "Copa do Brasil"), ("Vasco", "Outra")], "club string, competition string")
    got = B.honours(B.records(cells), allowed).collect()
    assert sorted((r.subject, r.object, r.year or 0) for r in got) == [("Santos", "Copa do Brasil", y) for y in (1962, 1963, 1968)] + [("Vasco", "Copa do Brasil", 0)]
    profile = {r.table: (r.kind, r.caption, r.rows, r.cols, r.head, r.spans) for r in B.profiles(cells).collect()}
    assert profile == {0: ("table", "Copa do Brasil", 6, 3, 2, 5), 1: ("table", "", 1, 1, 0, 0), 2: ("table", "", 1, 1, 0, 0), 3: ("pre", "", 2, 1, 0, 0)}
    targets = spark.createDataFrame([("t1", "VASCO", "s/d"), ("t2", "Santos", "1970"), ("t3", "", "x")], "target string, subject string, object string")
    assert [(r.table, r.row, r.target) for r in B.target_rows(cells, targets).collect()] == [(0, 5, "t1")]


def test_odd_spans(spark):
    assert B.placed([[("a", False, 0, 1), ("b", False, 9, 2)], [("c", False, 1, 1)], []]) == [
        (0, 0, "a", False, True), (1, 0, "a", False, False), (2, 0, "a", False, False),
        (0, 1, "b", False, True), (0, 2, "b", False, False), (1, 1, "b", False, False), (1, 2, "b", False, False), (2, 1, "b", False, False), (2, 2, "b", False, False),
        (1, 3, "c", False, True),
    ]
    cells = B.grids(page(spark, "<table><tr><td colspan=x rowspan=-1>a<td colspan=99999>b</table><table></table>")).collect()
    assert len(cells) == 1 + B.MOST_COLUMNS
    assert B.records(B.grids(page(spark).limit(0))).collect() == []


def test_a_grid_comes_back(spark):
    """Random grids cut into spanning cells are put together again."""
    r = random.Random(1)
    pages, want = [], {}
    for i in range(30):
        height, width = r.randrange(1, 7), r.randrange(1, 6)
        grid, rows = {}, [[] for _ in range(height)]
        for y in range(height):
            for x in range(width):
                if (y, x) in grid:
                    continue
                across = 1
                while x + across < width and (y, x + across) not in grid and r.random() < 0.3:
                    across += 1
                down = r.randrange(1, height - y + 1) if r.random() < 0.4 else 1
                name = f"c{y}{x}"
                grid |= {(y + b, x + a): name for b in range(down) for a in range(across)}
                rows[y].append(f"<td rowspan={down} colspan='{across}'>{name}</td>")
        pages.append("<table>" + "".join(f"<tr>{''.join(x)}</tr>" for x in rows) + "</table>")
        want[i] = grid
    got = {}
    for c in B.grids(page(spark, *pages)).collect():
        got.setdefault(c.page_id, {})[c.row, c.col] = c.text
    assert got == want
