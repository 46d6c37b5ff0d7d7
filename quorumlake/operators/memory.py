"""Episodes, their consolidation into relations, working memory and rate limits, as queries over event tables.

episodes: fact_hash, day, subject, predicate, object, source_domain, status, created_at, last_seen_at, replays, weight.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

#: Weight that one replay adds.
STEP = 0.1
# fixed values
INVERSES = {
    "UTILIZA": "UTILIZADO_POR", "UTILIZADO_POR": "UTILIZA", "PERTENCE_A": "CONTIENE", "CONTIENE": "PERTENCE_A", "PRODUZ": "PRODUZIDO_POR", "PRODUZIDO_POR": "PRODUZ",
    "EXECUTA": "EXECUTADO_POR", "EXECUTADO_POR": "EXECUTA", "CONECTA_A": "CONECTA_A", "DISTRIBUIR": "DISTRIBUIDO_POR", "DISTRIBUIDO_POR": "DISTRIBUIR", "DERIVA_DE": "ORIGINA", "ORIGINA": "DERIVA_DE",
}


def episodes(events: DataFrame) -> DataFrame:
    """Upsert by (fact_hash, day) of events (subject, predicate, object, source_domain, ts): the first spelling, first and last time, replays."""
    whole = events.dropna(subset=["subject", "predicate", "object"]).withColumn("fact_hash", T.fact_hash(F.col("subject"), F.col("predicate"), F.col("object"))).withColumn("day", F.to_date("ts"))
    first = F.min_by(F.struct("subject", "predicate", "object", "source_domain"), "ts")
    out = whole.groupBy("fact_hash", "day").agg(first.alias("f"), F.min("ts").alias("created_at"), F.max("ts").alias("last_seen_at"), F.count("*").alias("replays"))
    return out.select("fact_hash", "day", "f.*", "created_at", "last_seen_at", "replays", F.round(F.col("replays") * F.lit(STEP), 4).alias("weight"), F.lit("new").alias("status"))


def tally(eps: DataFrame, least: int = 2) -> DataFrame:
    """Replays of each triple over all days, at least `least`; most first."""
    out = eps.groupBy("subject", "predicate", "object").agg(F.sum("replays").alias("replays")).filter(F.col("replays") >= least)
    return out.orderBy(F.desc("replays"), "subject", "predicate", "object")


def with_inverses(edges: DataFrame, inverses: dict[str, str] | None = None) -> DataFrame:
    """edges and, of each predicate that has an inverse, the reversed edge."""
    table = INVERSES if inverses is None else inverses
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    back = edges.withColumn("inverse", F.try_element_at(pairs, F.col("predicate"))).filter("inverse is not null")
    rest = [c for c in edges.columns if c not in ("subject", "predicate", "object")]
    return edges.unionByName(back.select(F.col("object").alias("subject"), F.col("inverse").alias("predicate"), F.col("subject").alias("object"), *rest))


def consolidate(relations: DataFrame, tallied: DataFrame, additive: bool = False) -> DataFrame:
    """relations (subject, predicate, object, replays) joined with a tally: replays, weight and whether consolidated.

    The tally replaces older replays, so that a repeat changes nothing; additive: it is added to them.
    """
    key = ["subject", "predicate", "object"]
    both = relations.select(*key, F.col("replays").alias("old")).join(tallied.select(*key, F.col("replays").alias("new")), key, "full_outer")
    old, new = F.coalesce("old", F.lit(0)), F.col("new")
    replays = old + F.coalesce(new, F.lit(0)) if additive else F.coalesce(new, old)
    return both.select(*key, replays.alias("replays"), F.round(replays * F.lit(STEP), 4).alias("weight"), new.isNotNull().alias("consolidated"))


def mark(eps: DataFrame, hashes: DataFrame, status: str = "consolidated") -> DataFrame:
    """Episodes of the hashes get the status on all days."""
    known = hashes.select(F.col("fact_hash").alias("__h")).distinct()
    out = eps.join(known, eps["fact_hash"] == F.col("__h"), "left")
    return out.withColumn("status", F.when(F.col("__h").isNotNull(), status).otherwise(F.col("status"))).drop("__h")


def prune(eps: DataFrame, now: Column, days: int = 30, most: int = 10_000) -> DataFrame:
    """The episodes of the last `days`, and of these the `most` seen last: age by a filter, number by a global top-k."""
    young = eps.filter(F.col("created_at") >= now - F.expr(f"interval {days} days"))
    return young.orderBy(F.desc("last_seen_at"), "fact_hash", "day").limit(most)


def recent(eps: DataFrame, n: int = 20) -> DataFrame:
    """The last seen, 1 to 100."""
    return eps.orderBy(F.desc("last_seen_at"), "fact_hash", "day").limit(max(1, min(n, 100)))


def volatile(eps: DataFrame, least: int = 3, n: int = 20) -> DataFrame:
    """The last seen with a status by their replays over all days."""
    total = eps.groupBy("fact_hash").agg(F.sum("replays").alias("total"))
    kind = F.when(F.col("total") >= least, "consolidated").when(F.col("total") > 1, "repeated").otherwise("new")
    out = recent(eps, n).drop("status").join(total, "fact_hash")
    return out.withColumn("status", kind).withColumn("weight", F.round(F.col("total") * F.lit(STEP), 2))


def rate_limit(hits: DataFrame, limit: int, seconds: int) -> DataFrame:
    """hits (key, ts) with the number of attempts in the window that ends with each, itself and denied ones included, whether it
    is allowed, and the seconds to wait if not."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    frame = Window.partitionBy("key").orderBy("t").rangeBetween(-seconds * 1_000_000, 0)
    out = hits.withColumn("t", t).withColumn("attempts", F.count("*").over(frame)).withColumn("oldest", F.min("t").over(frame))
    wait = F.greatest(F.lit(1), F.ceil(F.lit(float(seconds)) - (F.col("t") - F.col("oldest")) / 1e6))
    ok = F.col("attempts") <= limit
    return out.withColumn("allowed", ok).withColumn("retry_after", F.when(ok, 0).otherwise(wait).cast("int")).drop("t", "oldest")


def working_memory(activations: DataFrame, capacity: int = 7, seconds: int = 300) -> DataFrame:
    """activations (mind, concept, ts) with the concepts active then: the `capacity` last activated ones of the last seconds (ties: the later name).

    Blank and null concepts activate nothing. Moments of a mind go by in order, with no more than `capacity` concepts held. Time is cut into spans, each of
    which starts with what was activated up to `seconds` before it, so a mind's moments are spread over tasks however many they are.
    """
    window, span = seconds * 1_000_000, 12 * seconds * 1_000_000
    timed = activations.withColumn("__t", F.unix_micros(F.col("ts").cast("timestamp")))
    concept = F.when(F.trim("concept") != "", F.col("concept"))
    moments = timed.groupBy("mind", F.col("__t").alias("t")).agg(F.collect_set(concept).alias("concepts")).withColumn("own", F.floor(F.col("t") / span))
    warm = F.col("t") >= (F.col("own") + 1) * span - window
    spread = moments.withColumn("span", F.explode(F.when(warm, F.array(F.col("own"), F.col("own") + 1)).otherwise(F.array(F.col("own")))))
    kind = activations.schema["mind"].dataType.simpleString()

    def run(batches):
        at, held = None, {}
        for b in batches:
            minds, spans, times, names, owns = (b.column(c).to_pylist() for c in ("mind", "span", "t", "concepts", "own"))
            out = []
            for mind, part, t, said, own in zip(minds, spans, times, names, owns, strict=True):
                if at != (mind, part):
                    at, held = (mind, part), {}
                held |= dict.fromkeys(said, t)
                held = {c: x for c, x in held.items() if x >= t - window}
                held = dict(sorted(held.items(), key=lambda x: (x[1], x[0]))[-capacity:])
                if own == part:
                    out.append((mind, t, sorted(held)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], b.column("mind").type), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.string()))], ["__mind", "__at", "active"])

    active = spread.repartition("mind", "span").sortWithinPartitions("mind", "span", "t").mapInArrow(run, f"__mind {kind}, __at bigint, active array<string>")
    same = F.col("mind").eqNullSafe(F.col("__mind")) & F.col("__t").eqNullSafe(F.col("__at"))
    return timed.join(active, same).drop("__mind", "__at", "__t")


def coactivations(active: DataFrame) -> DataFrame:
    """How often two concepts are active together (active: array)."""
    a = active.select(F.explode("active").alias("a"), "active")
    pairs = a.select("a", F.explode("active").alias("b")).filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def history(turns: DataFrame, last: int = 12, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last messages of each session."""
    place = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    return turns.withColumn("__r", place).filter(F.col("__r") <= last).drop("__r")


def sessions(turns: DataFrame, most: int = 200, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """The sessions used last: the others are evicted."""
    return turns.groupBy(session).agg(F.max(order).alias("last"), F.count("*").alias("messages")).orderBy(F.desc("last"), session).limit(most)


def last_lines(log: DataFrame, most: int = 5_000, by: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """What pruning a log leaves: its last lines, a distributed top-k."""
    return log.orderBy(*[F.desc(c) for c in by]).limit(most)


def delete_one(facts: DataFrame, key: str) -> DataFrame:
    """facts without the one of a key; an error unless there is exactly one, so that no delete reaches further than meant."""
    n = facts.filter(F.col("fact_key") == key).limit(2).count()
    if n != 1:
        raise ValueError(f"{'no' if not n else 'more than one'} fact has the key {key!r}")
    return facts.filter(~F.col("fact_key").eqNullSafe(key))


def delete_scope(facts: DataFrame, scope: DataFrame) -> DataFrame:
    """facts whose key isn't in the scope (fact_key): an anti join, so a rewrite of what stays."""
    return facts.join(scope.select("fact_key").distinct(), "fact_key", "left_anti")


def kept_keys(hits: DataFrame, now: Column, seconds: int, most: int) -> DataFrame:
    """(key, last): the keys that a bounded limiter still holds: those hit within the window, of these the `most` hit last (ties: by key)."""
    last = hits.groupBy("key").agg(F.max("ts").alias("last")).filter(F.col("last") > now - F.make_dt_interval(secs=F.lit(float(seconds))))
    return last.orderBy(F.desc("last"), "key").limit(most)


#: Hits a window of 60 seconds allows, by kind of request.
LIMITS = {"chat": 5, "extract_anonymous": 10, "extract": 120, "ingest": 120}


def rate_limits(hits: DataFrame, limits: dict[str, int] | None = None, seconds: int = 60) -> DataFrame:
    """(kind, hits, denied): hits (key, ts) under each limit; windows are counted once for all limits."""
    limits = limits or LIMITS
    counted = rate_limit(hits, 1, seconds).select("attempts")
    per = [F.count_if(F.col("attempts") > n).alias(k) for k, n in limits.items()]
    row = counted.agg(F.count("*").alias("hits"), *per)
    return row.select("hits", F.explode(F.create_map(*[x for k in limits for x in (F.lit(k), F.col(k))])).alias("kind", "denied"))
