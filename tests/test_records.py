"""Literal cases of the records of fixed layouts: nulls, empty tables, ties and rows that name nothing."""

from pyspark.sql import functions as F

from quorumlake.operators import extract as X
from quorumlake.operators import records as R


def test_honours_rows(spark):
    html = "<table><tr><th>Competição</th><th>n</th></tr><tr><td>Copa[1]</td><td>2</td><td>1962, 1963</td><td>1970, 1971</td></tr><tr><td>Copa</td><td></td></tr><tr><td>State</td><td>1999</td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<table><tr><td>a</td><td>1999</td></tr></table>")], "page_id bigint, html string")
    got = R.season_honours(X.table_rows(pages)).select("page_id", "competition", "year", "reason").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, None, None, "no_years"), (1, "Copa", 1962, "ok"), (1, "Copa", 1963, "ok"), (1, None, None, "section"), (4, None, None, "not_honours")], key=str)
    assert R.season_honours(X.table_rows(pages.limit(0))).count() == 0


def test_places_need_one_stadium_and_a_known_city(spark):
    texts = [(1, "A Arena Ébano fica em Santos, desde 1916"), (2, "Arena Ebano and Casa Alta are located in Santos"), (3, None), (4, "Arena Ebano is located in Nowhere")]
    pages = spark.createDataFrame(texts, "page_id bigint, html string")
    stadiums = spark.createDataFrame([("arena ébano", "ARENA"), ("casa alta", "CASA")], "alias string, stadium string")
    cities = spark.createDataFrame([("Santos desde 1916",), ("Santos",)], "city string")
    got = R.told_places(pages, stadiums, cities)
    assert [tuple(r) for r in got.collect()] == [(1, "ARENA", "LOCALIZADO_EM", "Santos")]
    assert R.told_places(pages, stadiums, cities.limit(0)).count() == 0


def test_expected_facts(spark):
    expected = spark.createDataFrame([("a", ["São José", "JOSE"], ["O Clube Um"]), ("b", ["Nobody"], ["x y"]), ("c", ["JOSE"], ["Clube Dois"])], "candidate_id string, subjects array<string>, objects array<string>")
    rows = [("1", "SAO JOSE", "P", "clube um", True, "d1"), ("1", "SAO JOSE", "P", "clube um", True, "d2"), ("2", "jose", "P", "clube um", False, "d3"), ("3", "jose", "Q", "clube dois", None, None), ("4", "jose", "P", "clube dois de outrora", None, "d1")]
    seen = spark.createDataFrame(rows, "fact_id string, subject string, predicate string, object string, verified boolean, domain string")
    by = {r.candidate_id: r for r in R.pilot_validation(expected, seen, ("d1",)).collect()}
    assert (by["a"].status, by["a"].domain_count, by["a"].outside, by["a"].meets_quorum) == ("verified", 2, True, False)
    assert (by["b"].status, by["b"].domain_count, by["b"].outside) == ("missing", 0, False)
    assert (by["c"].status, by["c"].domain_count) == ("partial", 0)
    state = {r.candidate_id: r for r in R.fact_states(expected, seen, "P", ("P",)).collect()}
    assert (state["a"].facts, state["a"].verified, state["a"].domain_count, state["a"].blocked) == (2, True, 3, False)
    assert (state["b"].facts, state["b"].verified, state["b"].outside, state["b"].invalid_predicate) == (0, False, False, False)
    assert (state["c"].facts, state["c"].span_broken, state["c"].blocked, state["c"].invalid_predicate) == (1, True, True, True)
    assert R.pilot_validation(expected.limit(0), seen).count() == R.fact_states(expected.limit(0), seen, "P", ()).count() == 0


def test_answers_and_bytes(spark):
    ok = "https://maps.example.org/s?format=json"
    rows = [(ok, "application/json", '[{"a": 1}, 2]'), (ok, "application/json", "{broken"), (ok, "application/json", None), (None, None, None), (ok, None, "{}")]
    got = R.json_answers(spark.createDataFrame(rows, "url string, content_type string, body string"), "maps.example.org").collect()
    assert [r.reason for r in got] == ["ok", "ok", "ok", "host", "content_type"]
    assert got[0].records == ['{"a":1}', "2"] and got[2].records == []
    said = spark.createDataFrame([("Resposta é".encode(x),) for x in ("utf-8-sig", "utf-16", "utf-16-le", "latin-1")] + [(b"",), (None,)], "b binary")
    assert [r[0] for r in said.select(R.decode_by_marker(F.col("b"), ("Resposta",))).collect()] == ["Resposta é"] * 4 + ["", None]
    assert [r[0] for r in spark.createDataFrame([("Ele JOGOU, jogou e venceu",), (None,)], "t string").select(R.domain_verbs(F.col("t"))).collect()] == [["jogou", "venceu"], []]
