"""Streams of bounded state agree with the batch forms, whatever the micro-batches; batch working memory with a plain replay."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quorumlake.operators import memory as M
from quorumlake.streaming import stateful as S

T0 = datetime(2024, 1, 1)


def stream(spark, tmp_path, rows, schema, parts):
    """A stream with so many files, one a micro-batch, in order."""
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def run(df, name, tmp_path):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return df.sparkSession.table(name)


def replay(rows, capacity, seconds):
    out = []
    for i, (mind, _, t) in enumerate(rows):
        last = {}
        for m, c, x in rows:
            if m == mind and c and c.strip() and t - timedelta(seconds=seconds) <= x <= t:
                last[c] = max(x, last.get(c, x))
        out.append((i, sorted(sorted(last, key=lambda c: (last[c], c))[-capacity:])))
    return out


@pytest.mark.parametrize(("capacity", "seconds"), [(3, 60), (7, 300), (1, 1)])
def test_working_memory_as_a_replay(spark, capacity, seconds):
    r = random.Random(capacity)
    rows = [(r.choice(["a", "b", None]), r.choice(["x", "y", "z", "u", "v", " ", None]), T0 + timedelta(seconds=r.randrange(4000))) for _ in range(250)]
    rows += [("a", "x", T0 - timedelta(days=9000)), ("a", "y", T0 - timedelta(days=9000))] + rows[:3]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, mind string, concept string, ts timestamp")
    got = M.working_memory(df, capacity, seconds)
    assert got.columns == ["i", "mind", "concept", "ts", "active"]
    assert sorted((x.i, x.active) for x in got.collect()) == replay(rows, capacity, seconds)
    assert M.working_memory(df.limit(0)).collect() == []


def test_working_memory_stream(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.randrange(3), r.choice("uvwxyz"), T0 + timedelta(seconds=i * 7)) for i in range(90)] + [(0, " ", T0 + timedelta(seconds=700))]
    schema = "mind int, concept string, ts timestamp"
    got = run(S.working_memory_stream(stream(spark, tmp_path, rows, schema, 3), 3, 40), "slots", tmp_path)
    want = M.working_memory(spark.createDataFrame(rows[:-1], schema), 3, 40)
    assert sorted((x.mind, x.concept, x.ts, x.active) for x in got.collect()) == sorted((x.mind, x.concept, x.ts, x.active) for x in want.collect())
    state = spark.read.format("statestore").option("stateVarName", "slots").load(str(tmp_path / "ck"))
    assert all(n <= 3 for (n,) in state.groupBy("key").agg(F.count("*")).select("count(1)").collect())


def test_a_key_that_hammers_keeps_a_bounded_state(spark, tmp_path):
    rows = [("hot", T0 + timedelta(milliseconds=40 * i)) for i in range(400)] + [(f"k{i % 3}", T0 + timedelta(seconds=5 * i, milliseconds=i)) for i in range(40)]
    rows.sort(key=lambda x: x[1])
    schema = "key string, ts timestamp"
    got = run(S.bounded_rate_limit_stream(stream(spark, tmp_path, rows, schema, 3), 4, 30), "bounded", tmp_path)
    want = M.rate_limit(spark.createDataFrame(rows, schema), 4, 30)
    assert sorted((x.key, x.ts, x.attempts, x.allowed) for x in got.collect()) == sorted((x.key, x.ts, min(x.attempts, 5), x.allowed) for x in want.collect())
    state = spark.read.format("statestore").option("stateVarName", "ring").load(str(tmp_path / "ck"))
    assert all(len(x.value.times) <= 4 for x in state.collect())


def test_idle_keys_are_dropped(spark, tmp_path):
    rows = [("old", T0), ("new", T0 + timedelta(hours=2)), ("new", T0 + timedelta(hours=4))]
    run(S.bounded_rate_limit_stream(stream(spark, tmp_path, rows, "key string, ts timestamp", 3), 4, 30), "idle", tmp_path)
    state = spark.read.format("statestore").option("stateVarName", "ring").load(str(tmp_path / "ck"))
    assert [x.key[0] for x in state.collect()] in ([], ["new"])
