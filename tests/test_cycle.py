"""A measured cycle: counters by page, manifest by batch, lock, and the facts of the batch form."""

import pytest
from pyspark.errors import PySparkException

from quorumlake.operators import graph as G
from quorumlake.streaming import cycle as C
from quorumlake.streaming import store as K

PAGE = "page_id bigint, url string, status int, html string"
PAGES = [
    (1, "https://a.org/1", 200, "<p>Santos venceu Copa do Brasil. Nada mais.</p>"),
    (2, "https://b.org/2", None, "<p>Santos venceu Copa do Brasil; Santos venceu Copa do Brasil</p>"),
    (3, "https://c.org/3", 404, "<p>Santos venceu Copa do Brasil.</p>"),
    (4, "https://c.org/4", 200, "<script>x</script>"),
    (5, "https://c.org/5", 200, "<p>Only words here.</p>"),
    (6, "https://c.org/6", 200, "<p>que venceu de.</p>"),
    (7, "https://d.org/7", 200, None),
]


def test_cycles_follow_a_stream(spark, tmp_path):
    store, source = str(tmp_path / "store"), str(tmp_path / "in")
    for n, part in enumerate((PAGES[:4], PAGES[4:])):
        spark.createDataFrame(part, PAGE).coalesce(1).write.mode("append").json(source)
        rows = C.run(spark.readStream.schema(PAGE).json(source), store, str(tmp_path / "ck")).collect()
        assert len(rows) == n + 1
    got = {r.page_id: (r.stage, r.raw, r.canonical, r.facts) for r in C.diagnosed(spark, store).collect()}
    assert got == {
        1: ("ok", 1, 1, 1), 2: ("ok", 2, 2, 1), 3: ("fetch_failed", 0, 0, 0), 4: ("empty_page", 0, 0, 0), 5: ("no_triples", 0, 0, 0), 6: ("all_rejected", 1, 0, 0), 7: ("empty_page", 0, 0, 0),
    }
    total = {c: sum(r[c] for r in rows) for c in ("pages", "fetched", "raw", "canonical", "facts")}
    assert total == {"pages": 7, "fetched": 6, "raw": 4, "canonical": 3, "facts": 2}
    facts = K.current(spark, f"{store}/facts", K.FACTS)
    (row,) = facts.collect()
    assert (row.subject, row.predicate, row.object, row.occurrences, row.domains) == ("Santos", "VENCEU", "Copa do Brasil", 3, 2)
    _, triples = C.stages(spark.createDataFrame(PAGES, PAGE))
    assert G.facts(triples).select("fact_key", "occurrences", "domains", "urls").collect() == facts.select("fact_key", "occurrences", "domains", "urls").collect()


def test_a_batch_run_again_and_the_lock(spark, tmp_path):
    store = str(tmp_path / "store")
    for _ in range(2):
        C.take(spark.createDataFrame(PAGES, PAGE), 0, store)
    assert [(r.batch, r.pages, r.raw) for r in C.manifest(spark, store).collect()] == [(0, 7, 4)]
    assert C.diagnosed(spark, store).count() == 7
    (tmp_path / "store" / "_lock").write_text("")
    spark.createDataFrame(PAGES, PAGE).write.json(str(tmp_path / "in"))
    with pytest.raises(PySparkException):
        C.run(spark.readStream.schema(PAGE).json(str(tmp_path / "in")), store, str(tmp_path / "ck"))
    C.take(spark.createDataFrame([], PAGE), 1, store)
    assert [r.pages for r in C.manifest(spark, store).orderBy("batch").collect()] == [7, 0]
