"""Opinion dynamics on the graph: synchronous rounds of bounded confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.small import checkpoints


def inject(agents: DataFrame, injections: DataFrame) -> DataFrame:
    """agents (name, stance, influence) with the stances of known names set, between 0 and 1."""
    fixed = injections.select("name", F.col("stance").alias("new"))
    return agents.join(fixed, "name", "left").withColumn("stance", F.when(F.col("new").isNull(), F.col("stance")).otherwise(F.least(F.greatest("new", F.lit(0.0)), F.lit(1.0)))).drop("new")


def run(agents: DataFrame, edges: DataFrame, rounds: int = 12, alpha: float = 0.35, threshold: float = 0.25) -> DataFrame:
    """(round, name, stance) from round 0 to `rounds` (50 at most).

    Each round an agent moves by alpha to the mean, weighed by influence, of its neighbours (edges: name, neighbour, both ways) that
    are within the threshold, or of all if none is. Agents without neighbours stay. Rounds are checkpointed, as lineage grows.
    """
    checkpoints(agents.sparkSession)
    now = agents.select("name", "stance", "influence").checkpoint()
    history = [now.select(F.lit(0).alias("round"), "name", "stance")]
    for i in range(1, max(0, min(rounds, 50)) + 1):
        other = now.select(F.col("name").alias("neighbour"), F.col("stance").alias("s"), F.col("influence").alias("w"))
        near = F.abs(F.col("s") - F.col("stance")) <= threshold
        means = edges.join(other, "neighbour").join(now.select("name", "stance"), "name").groupBy("name")
        sums = means.agg(
            F.sum(F.when(near, F.col("s") * F.col("w"))).alias("close"), F.sum(F.when(near, F.col("w"))).alias("close_w"),
            F.sum(F.col("s") * F.col("w")).alias("all"), F.sum("w").alias("all_w"),
        )
        goal = F.coalesce(F.expr("try_divide(close, close_w)"), F.expr("try_divide(`all`, all_w)"), F.col("stance"))
        moved = (1 - F.lit(alpha)) * F.col("stance") + F.lit(alpha) * goal
        now = now.join(sums, "name", "left").select("name", F.when(F.col("all_w").isNull(), F.col("stance")).otherwise(F.least(F.greatest(moved, F.lit(0.0)), F.lit(1.0))).alias("stance"), "influence")
        now = now.checkpoint()
        history.append(now.select(F.lit(i).alias("round"), "name", "stance"))
    out = history[0]
    for h in history[1:]:
        out = out.union(h)
    return out


def report(stances: DataFrame, edges: int) -> DataFrame:
    """One row on a round's stances: mean, population deviation, consensus, polarization, confidence, verdict, extremes."""
    row = stances.agg(
        F.count("*").alias("agents"), F.avg("stance").alias("mean"), F.stddev_pop("stance").alias("std"), F.avg(F.when((F.col("stance") <= 0.3) | (F.col("stance") >= 0.7), 1.0).otherwise(0.0)).alias("polarization"),
        F.max_by("name", F.struct("stance", "name")).alias("dominant"), F.min_by("name", F.struct("stance", "name")).alias("weakest"),
    )
    row = row.withColumn("consensus", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 2 * F.col("std"))))
    density = F.lit(float(edges)) / F.greatest(F.lit(1.0), F.col("agents") * (F.col("agents") - 1) / 2)
    verdict = F.when(F.col("consensus") >= 0.75, "convergence").when(F.col("polarization") >= 0.5, "polarization").otherwise("divergence")
    return row.select("agents", *[F.round(c, 3).alias(c) for c in ("mean", "std", "consensus", "polarization")], F.round(0.6 * F.col("consensus") + 0.4 * F.least(F.lit(1.0), density), 3).alias("confidence"), verdict.alias("verdict"), "dominant", "weakest")


def histogram(stances: DataFrame) -> DataFrame:
    return stances.groupBy(F.round("stance", 1).alias("bucket")).agg(F.count("*").alias("agents"))
