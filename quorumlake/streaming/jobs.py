"""Structured Streaming forms of the stateful operators; each agrees with its batch form on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import store as K


def episode_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Episodes by fact and day of a stream of events: a day is final once the watermark has passed it."""
    keyed = events.withColumn("fact_hash", T.fact_hash(F.col("subject"), F.col("predicate"), F.col("object"))).withWatermark("ts", late)
    out = keyed.groupBy("fact_hash", F.window("ts", "1 day").alias("w")).agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_seen_at"), F.count("*").alias("replays"))
    return out.select("fact_hash", F.to_date("w.start").alias("day"), "created_at", "last_seen_at", "replays")


def deduplicated(events: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def rate_limit_stream(hits: DataFrame, limit: int, seconds: int) -> DataFrame:
    """(key, ts, attempts, allowed) of a stream of hits (key, ts): state per key is the times within the window, dropped when idle."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        new = sorted(t for p in parts for t in p.ts.astype("datetime64[us]").astype("int64"))
        out = []
        for t in new:
            times = [x for x in times if x >= t - seconds * 1_000_000] + [t]
            out.append((key[0], pd.Timestamp(t, unit="us"), len(times), len(times) <= limit))
        state.update((times,))
        state.setTimeoutDuration(seconds * 1000)
        yield pd.DataFrame(out, columns=["key", "ts", "attempts", "allowed"])

    return hits.select("key", "ts").groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, attempts long, allowed boolean", "times array<long>", "append", "ProcessingTimeTimeout")


def session_stream(turns: DataFrame, gap: str = "30 minutes") -> DataFrame:
    out = turns.withWatermark("ts", gap).groupBy("session", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("messages"))
    return out.select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "messages")


def upsert_batches(stream: DataFrame, store: str, checkpoint: str):
    """Facts under `store` kept up with a stream of occurrences; a micro-batch reads the buckets of its own facts alone (see store)."""
    return K.upserts(stream, store, checkpoint, K.FACTS)


def latest(spark, store: str) -> DataFrame:
    """Facts as the last batch left them."""
    return K.current(spark, store, K.FACTS)


def late_episodes(stream: DataFrame, store: str, checkpoint: str):
    """Episodes under `store` kept up with a stream of events that may come at any time and in any order: a late event re-opens its day, and
    store.changes has the row that it takes back and the one that it puts in its place."""
    return K.upserts(stream, store, checkpoint, K.EPISODES)
