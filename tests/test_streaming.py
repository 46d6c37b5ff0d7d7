"""Streaming forms agree with batch forms on the same rows."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quorumlake.operators import graph as G
from quorumlake.operators import memory as M
from quorumlake.sources import readers as IO
from quorumlake.streaming import jobs as J


def source(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).repartition(1).write.json(str(tmp_path / "in"), timestampFormat="yyyy-MM-dd HH:mm:ss")
    return spark.readStream.schema(schema).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").json(str(tmp_path / "in"))


def run(stream, name, mode, tmp_path):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_episodes(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("u", "click", f"k{i % 2}", t0 + timedelta(hours=7 * i)) for i in range(20)]
    schema = "subject string, predicate string, object string, ts timestamp"
    got = run(J.episode_stream(source(spark, tmp_path, rows, schema)), "episodes", "complete", tmp_path)
    want = M.episodes(spark.createDataFrame(rows, schema).withColumn("source_domain", F.lit("d")))
    assert sorted((r.fact_hash, str(r.day), r.replays) for r in got.collect()) == sorted((r.fact_hash, str(r.day), r.replays) for r in want.collect())


def test_rate_limit(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(f"k{i % 3}", t0 + timedelta(seconds=i * 5)) for i in range(40)]
    schema = "key string, ts timestamp"
    got = run(J.rate_limit_stream(source(spark, tmp_path, rows, schema), 3, 60), "limits", "append", tmp_path)
    want = M.rate_limit(spark.createDataFrame(rows, schema), 3, 60)
    assert sorted((r.key, str(r.ts), r.attempts, r.allowed) for r in got.collect()) == sorted((r.key, str(r.ts), r.attempts, r.allowed) for r in want.collect())


def test_incremental_facts(spark, tmp_path):
    rows = [(f"s{i % 4}", "p", "o", f"u{i}", f"d{i % 5}", 0.5, i) for i in range(40)]
    schema = "subject string, predicate string, object string, url string, domain string, confidence double, seq int"
    stream = source(spark, tmp_path, rows, schema)
    J.upsert_batches(stream, str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination(120)
    got = J.latest(spark, str(tmp_path / "store"))
    want = G.facts(spark.createDataFrame(rows, schema))
    key = ("fact_key", "occurrences", "domains", "verified")
    assert sorted(tuple(r[k] for k in key) for r in got.collect()) == sorted(tuple(r[k] for k in key) for r in want.collect())


def test_logs_and_fact_files(spark, tmp_path):
    IO.append_log(spark.createDataFrame([(1.0, "x", None), (2.0, "y", None)], IO.EPISODE), str(tmp_path / "log"))
    IO.append_log(spark.createDataFrame([(3.0, "z", None)], IO.EPISODE), str(tmp_path / "log"))
    assert [r.kind for r in IO.episode_log(spark, str(tmp_path / "log"), 2).collect()] == ["z", "y"]
    fact = {"subject": "a", "predicate": "p", "object": "b"}
    for name, text in (("list", json.dumps([fact])), ("wrapped", json.dumps({"facts": [fact, fact]})), ("lines", json.dumps(fact) + "\n" + json.dumps(fact))):
        (tmp_path / name).write_text(text)
        assert IO.fact_file(spark, str(tmp_path / name)).count() == (1 if name == "list" else 2)


def test_dump_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    edges = spark.createDataFrame([("a", "b", "t"), ("b", "a", "s")], "src string, dst string, type string")
    IO.write_dump(nodes, edges, str(tmp_path / "dump"))
    n, e = IO.read_dump(spark, str(tmp_path / "dump"))
    assert n.exceptAll(nodes).isEmpty() and e.select("src", "dst", "type").exceptAll(edges).isEmpty()
