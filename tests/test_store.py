"""The store that follows a stream: equal to batch in any order, bounded reads, batches run again, compaction."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quorumlake.operators import graph as G
from quorumlake.operators import memory as M
from quorumlake.streaming import jobs as J
from quorumlake.streaming import store as K

OCC = "subject string, predicate string, object string, url string, domain string, confidence double, seq int"
EVENT = "subject string, predicate string, object string, source_domain string, ts timestamp"


def occurrences(n, seed=1, names=12):
    r = random.Random(seed)
    rows = [(f"S{r.randrange(names)}", r.choice("pq"), r.choice(["o", "O", "x"]), f"u{r.randrange(9)}", r.choice([f"d{r.randrange(5)}", None]), 0.5, i) for i in range(n)]
    return rows + [("S0", "p", "o", None, None, 0.5, n), (None, "p", "o", "u1", "d1", 0.5, n + 1), ("S0", "p", "o", None, None, 0.5, n + 2)]


def facts(df):
    keys = ("fact_key", "fact_hash", "subject", "predicate", "object", "occurrences", "domains", "urls", "verified")
    return sorted((tuple(r[k] for k in keys) for r in df.collect()), key=str)


@pytest.mark.parametrize("target", [20_000, 8])
def test_equal_to_batch_in_any_order(spark, tmp_path, monkeypatch, target):
    monkeypatch.setattr(K, "TARGET", target)
    monkeypatch.setattr(K, "DELTAS", 2)
    rows = occurrences(120)
    random.Random(2).shuffle(rows)
    store = str(tmp_path / "store")
    for n in range(6):
        K.apply(spark.createDataFrame(rows[n * 21 : (n + 1) * 21], OCC), n, store, K.FACTS)
        K.apply(spark.createDataFrame(rows[n * 21 : (n + 1) * 21], OCC), n, store, K.FACTS)  # once more, as after a crash
    assert facts(K.current(spark, store, K.FACTS)) == facts(G.facts(spark.createDataFrame(rows, OCC)))
    assert any(n.startswith("base") for n in K.layout(spark, store).names)
    # what was put less what was taken back is the table
    net = K.changes(spark, store).groupBy("fact_key", "occurrences", "domains", "urls").agg(F.sum(F.when(F.col("op") == "+", 1).otherwise(-1)).alias("n")).filter("n <> 0")
    assert sorted(map(tuple, net.collect()), key=str) == sorted([(r[0], *r[5:8], 1) for r in facts(K.current(spark, store, K.FACTS))], key=str)


def test_empty_and_first_batch(spark, tmp_path):
    store = str(tmp_path / "store")
    K.apply(spark.createDataFrame([], OCC), 0, store, K.FACTS)
    K.apply(spark.createDataFrame(occurrences(5), OCC), 1, store, K.FACTS)
    K.apply(spark.createDataFrame([], OCC), 2, store, K.FACTS)
    assert facts(K.current(spark, store, K.FACTS)) == facts(G.facts(spark.createDataFrame(occurrences(5), OCC)))


def test_a_broken_off_compaction_counts_for_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = occurrences(40)
    for n in range(3):
        K.apply(spark.createDataFrame(rows[n * 14 : (n + 1) * 14], OCC), n, store, K.FACTS)
    want = facts(G.facts(spark.createDataFrame(rows[:42], OCC)))
    (tmp_path / "store" / "base-9-4" / "state").mkdir(parents=True)
    (tmp_path / "store" / "delta-0-2" / "state").mkdir(parents=True)
    assert facts(K.current(spark, store, K.FACTS)) == want
    K.compact(spark, store, K.FACTS)
    assert facts(K.current(spark, store, K.FACTS)) == want


def test_a_batch_reads_no_more_of_a_larger_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "TARGET", 50)
    store, read = str(tmp_path / "store"), []
    batch = spark.createDataFrame([("S1", "p", "o", "new", "d9", 0.5, -1), ("S2", "q", "x", "new", "d9", 0.5, -2)], OCC)
    new = K.FACTS.rows(batch)
    for n in range(4):
        rows = [(f"S{i}", "p", "o", f"u{n}", f"d{i % 7}", 0.5, i) for i in range(400 * 2**n)]
        K.apply(spark.createDataFrame(rows, OCC), n, store, K.FACTS)
        K.compact(spark, store, K.FACTS)
        at = K.layout(spark, store)
        held = K.touched(spark, store, K.FACTS, at, new)
        of = K._read(spark, store, at.names, {r[0] for r in new.select(F.pmod(F.xxhash64("fact_key"), F.lit(at.buckets)).cast("int")).collect()})
        read.append((of.count(), K._read(spark, store, at.names).count()))
        assert held.filter("fact_key like 's1|%'").count() == n + 1
    assert read[-1][1] > 6 * read[0][1]
    assert max(r for r, _ in read) <= 2 * 4 * K.TARGET


def test_streams(spark, tmp_path):
    rows = occurrences(60)
    spark.createDataFrame(rows, OCC).repartition(3).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(OCC).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    J.upsert_batches(stream, str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination(180)
    assert facts(J.latest(spark, str(tmp_path / "store"))) == facts(G.facts(spark.createDataFrame(rows, OCC)))


def test_late_events_reopen_their_day(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("u", "click", f"k{i % 3}", "d", t0 + timedelta(hours=5 * i, seconds=i)) for i in range(60)] + [(None, "click", "k", "d", t0)]
    late = rows[::-1][:31] + rows[:30]  # the last days first, the first ones after them
    store = str(tmp_path / "store")
    for n in range(4):
        K.apply(spark.createDataFrame(late[n * 16 : (n + 1) * 16], EVENT), n, store, K.EPISODES)
    keys = ("fact_hash", "day", "subject", "object", "created_at", "last_seen_at", "replays")

    def shown(df):
        return sorted(tuple(map(str, (r[k] for k in keys))) for r in df.collect())

    want = M.episodes(spark.createDataFrame(rows, EVENT))
    assert shown(K.current(spark, store, K.EPISODES)) == shown(want)
    feed = K.changes(spark, store)
    assert feed.filter("op = '-'").count() > 0
    net = feed.groupBy(*keys).agg(F.sum(F.when(F.col("op") == "+", 1).otherwise(-1)).alias("n")).filter("n <> 0")
    assert shown(net) == shown(want) and net.filter("n <> 1").isEmpty()
