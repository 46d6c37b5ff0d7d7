"""Working memory and rate limits as streams whose state is bounded by their capacity, however often a key is hit.

State is in RocksDB, key by key; keys that are idle beyond their window are dropped by timers on event time. Within a micro-batch the rows of a key go by
time; a row that comes behind later ones of its key counts from its own time on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """State of the kinds used here is kept by no other store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _by_time(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values("t", kind="stable")


class _Idle(StatefulProcessor):
    """One timer for each key, at the end of its last window."""

    def __init__(self, seconds: int):
        self.micros = seconds * 1_000_000

    def until(self, last: int) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer((last + self.micros) // 1000 + 1)

    def close(self) -> None:
        pass


class _Slots(_Idle):
    """concept -> last activation, of the `capacity` activated last."""

    def __init__(self, capacity: int, seconds: int):
        super().__init__(seconds)
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.slots = handle, handle.getMapState("slots", "concept string", "t bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {c[0]: t[0] for c, t in self.slots.iterator()}
        before, out = dict(held), []
        for concept, t in _by_time(rows)[["concept", "t"]].itertuples(index=False):
            held[concept] = max(t, held.get(concept, t))
            held = {c: x for c, x in held.items() if x >= t - self.micros}
            held = dict(sorted(held.items(), key=lambda x: (x[1], x[0]))[-self.capacity :])
            out.append((key[0], concept, pd.Timestamp(t, unit="us"), sorted(held)))
        for c in before.keys() - held.keys():
            self.slots.removeKey((c,))
        for c, t in held.items():
            if before.get(c) != t:
                self.slots.updateValue((c,), (t,))
        self.until(max(held.values()))
        yield pd.DataFrame(out, columns=["mind", "concept", "ts", "active"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.slots.clear()
        return iter([])


class _Ring(_Idle):
    """The times of the last `limit` hits: the oldest of them tells whether another is too much."""

    def __init__(self, limit: int, seconds: int):
        super().__init__(seconds)
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.ring = handle, handle.getValueState("ring", "times array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = list(self.ring.get()[0]) if self.ring.exists() else []
        out = []
        for t in _by_time(rows)["t"]:
            near = [x for x in times if x >= t - self.micros]
            out.append((key[0], pd.Timestamp(t, unit="us"), len(near) + 1, len(near) < self.limit))
            times = sorted([*near, t])[-self.limit :]
        self.ring.update((times,))
        self.until(times[-1])
        yield pd.DataFrame(out, columns=["key", "ts", "attempts", "allowed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ring.clear()
        return iter([])


def _timed(stream: DataFrame, *columns: str, late: str) -> DataFrame:
    return stream.withWatermark("ts", late).select(*columns, "ts", F.unix_micros("ts").alias("t"))


def working_memory_stream(activations: DataFrame, capacity: int = 7, seconds: int = 300, late: str = "1 minute") -> DataFrame:
    """(mind, concept, ts, active) of a stream of activations (mind, concept, ts): the concepts active then, as memory.working_memory; blank concepts
    activate nothing. State: `capacity` concepts a mind."""
    keep_state_in_rocksdb(activations.sparkSession)
    rows = _timed(activations.filter("trim(concept) <> ''"), "mind", "concept", late=late)
    schema = f"mind {rows.schema['mind'].dataType.simpleString()}, concept string, ts timestamp, active array<string>"
    return rows.groupBy("mind").transformWithStateInPandas(_Slots(capacity, seconds), schema, "Append", "EventTime")


def bounded_rate_limit_stream(hits: DataFrame, limit: int, seconds: int, late: str = "1 minute") -> DataFrame:
    """(key, ts, attempts, allowed) of a stream of hits (key, ts), denied ones counted too, as memory.rate_limit; attempts beyond limit + 1 are given
    as that. State: `limit` times a key, so a key that hammers costs no more than one that doesn't."""
    keep_state_in_rocksdb(hits.sparkSession)
    rows = _timed(hits, "key", late=late)
    schema = f"key {rows.schema['key'].dataType.simpleString()}, ts timestamp, attempts bigint, allowed boolean"
    return rows.groupBy("key").transformWithStateInPandas(_Ring(limit, seconds), schema, "Append", "EventTime")
