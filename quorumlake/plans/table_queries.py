"""Queries on tables of HTML: suppliers set as tables with captions, spanning headers and cells, and read off them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables as B
from .registry import query


def _pages(t):
    """A page for each nation: a table of its suppliers by band, the band in one cell beside all its rows."""
    s = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    band = F.when(F.col("s_suppkey") % 3 == 0, "third").otherwise("other")
    rows = s.groupBy("n_nationkey", "n_name", band.alias("band")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("m"))
    line = F.transform("m", lambda x, i: F.concat(F.lit("<tr>"), F.when(i == 0, F.concat(F.lit("<td rowspan="), F.size("m").cast("string"), F.lit(">"), F.col("band"), F.lit("</td>"))).otherwise(""), F.lit("<td><b>"), x["s_name"], F.lit("</b></td><td>no "), x["s_suppkey"].cast("string"), F.lit("</td></tr>")))
    rows = rows.select("n_nationkey", "n_name", "band", F.array_join(line, "").alias("html"))
    pages = rows.groupBy("n_nationkey", "n_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("band", "html"))), lambda x: x["html"]), "").alias("body"))
    head = "<tr><th rowspan=2>Band</th><th colspan=2>Supplier</th></tr><tr><th>Name</th><th>Number</th></tr>"
    return pages.select(F.col("n_nationkey").alias("page_id"), F.concat(F.lit("<p>of</p><table><caption>From "), "n_name", F.lit(f"</caption>{head}"), "body", F.lit("</table>")).alias("html"))


_ROWS = "s AS (SELECT n_nationkey AS page_id, n_name, s_name, s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'third' ELSE 'other' END AS band FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@query("g15_table_records", f"WITH {_ROWS} SELECT page_id, 'From ' || n_name AS caption, (1 + row_number() OVER (PARTITION BY page_id ORDER BY band, s_suppkey))::INT AS row, 'Band=' || band || ';Supplier Name=' || s_name || ';Supplier Number=no ' || s_suppkey AS fields FROM s")
def _(t):
    rows = B.records(B.grids(_pages(t)))
    return rows.select("page_id", "caption", "row", F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit("="), f["text"])), ";").alias("fields"))


@query("g15_table_profiles", f"WITH {_ROWS} SELECT page_id, 'table' AS kind, 'From ' || n_name AS caption, (count(*) + 2)::INT AS rows, 3::INT AS cols, 2::INT AS head, (2 + count(*) - count(DISTINCT band))::BIGINT AS spans FROM s GROUP BY ALL")
def _(t):
    return B.profiles(B.grids(_pages(t))).select("page_id", "kind", "caption", "rows", "cols", "head", "spans")


@query("g09_table_honours", "SELECT o_custkey AS page_id, 'c' || o_custkey AS subject, 'VENCEU' AS predicate, 'Copa ' || o_orderpriority AS object, year(o_orderdate)::INT AS year FROM orders GROUP BY ALL")
def _(t):
    """Orders as honours: a table for each customer and priority, which its caption tells, with the years of a club in one cell."""
    o = t("orders").groupBy("o_custkey", "o_orderpriority").agg(F.array_sort(F.collect_set(F.year("o_orderdate"))).alias("y"))
    html = F.concat(F.lit("<table><caption>Copa "), "o_orderpriority", F.lit("</caption><tr><th>Clube</th><th>Anos</th></tr><tr><td>C"), F.col("o_custkey").cast("string"), F.lit("</td><td>"), F.array_join(F.transform("y", lambda y: y.cast("string")), ", "), F.lit("</td></tr></table>"))
    pages = o.select("o_custkey", html.alias("html")).groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_join(F.array_sort(F.collect_list("html")), "").alias("html"))
    allowed = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("club"), F.concat(F.lit("Copa "), "o_orderpriority").alias("competition")).distinct()
    return B.honours(B.records(B.grids(pages)), allowed)
