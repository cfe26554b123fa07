"""Operators on sequences of predicted transport modes: (track, id, t, mode, prob)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.operators.trajectory import along

# The order in which equally frequent modes win, rest last as it only wins alone.
LABELS = ("walk", "bike", "car", "bus", "train", "still")
REST = "still"
CHANGED_PROB = 1e-6


def best_mode(probs: Column, labels: list[str]) -> Column:
    """The label of the greatest probability; the first of equal ones, null for a null or empty list."""
    at = F.array_position(probs, F.array_max(probs)).cast("int")
    return F.get(F.array(*[F.lit(x) for x in labels]), at - 1)


def compress(df: DataFrame, value: str = "mode") -> DataFrame:
    """The first row of each run of equal values within a track."""
    w = along()
    return df.withColumn("was", F.lag(value).over(w)).withColumn("rn", F.row_number().over(w)).where((F.col("rn") == 1) | ~F.col("was").eqNullSafe(F.col(value))).drop("was", "rn")


def _vote(counts: dict[str, Column]) -> Column:
    """The most frequent mode other than rest, by label order on ties; rest only if nothing else occurs."""
    moving = [m for m in counts if m != REST]
    top = F.greatest(*[counts[m] for m in moving])
    e = F.lit(REST)
    for m in reversed(moving):
        e = F.when(counts[m] == top, F.lit(m)).otherwise(e)
    return F.when(top == 0, F.lit(REST)).otherwise(e)


def majority_vote(df: DataFrame, n: int, iterations: int = 1) -> DataFrame:
    """Each mode replaced by the majority of the ``n`` rows to either side; a changed row's probability becomes 1e-6.

    Counts come from running totals taken at the ends of the frame, so the cost does not grow with ``n``.
    """
    w = along()
    total = w.rowsBetween(Window.unboundedPreceding, 0)
    for _ in range(iterations):
        sums = {m: F.sum((F.col("mode") == m).cast("long")).over(total) for m in LABELS}
        x = df.withColumns({f"s_{m}": e for m, e in sums.items()})
        x = x.withColumn("rn", F.row_number().over(w)).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("track")))
        ends = F.struct(*[f"s_{m}" for m in LABELS])
        last = F.max(ends).over(Window.partitionBy("track"))  # totals never fall, so the greatest is the last
        x = x.withColumns({"hi": F.coalesce(F.lead(ends, n).over(w), last), "lo": F.lag(ends, n + 1).over(w)})
        counts = {m: F.col(f"hi.s_{m}") - F.coalesce(F.col(f"lo.s_{m}"), F.lit(0)) for m in LABELS}
        x = x.withColumn("vote", _vote(counts))
        df = x.select(*[c for c in df.columns if c not in ("mode", "prob")], F.col("vote").alias("mode"), F.when(F.col("vote") == F.col("mode"), F.col("prob")).otherwise(F.lit(CHANGED_PROB)).alias("prob"))
    return df


def majority_vote_batched(df: DataFrame, n: int) -> DataFrame:
    """Each mode replaced by the majority of its batch of ``n`` successive rows of the track."""
    x = df.withColumn("batch", F.floor((F.row_number().over(along()) - 1) / n))
    b = Window.partitionBy("track", "batch")
    counts = {m: F.sum((F.col("mode") == m).cast("long")).over(b) for m in LABELS}
    x = x.withColumns({f"c_{m}": e for m, e in counts.items()}).withColumn("vote", _vote({m: F.col(f"c_{m}") for m in LABELS}))
    return x.select(*[c for c in df.columns if c not in ("mode", "prob")], F.col("vote").alias("mode"), F.when(F.col("vote") == F.col("mode"), F.col("prob")).otherwise(F.lit(CHANGED_PROB)).alias("prob"))


def weighted_vote(df: DataFrame, n: int, width: int) -> DataFrame:
    """Add ``winner``, the position (from 1) of the greatest sum of ``probs`` over the ``n`` rows to either side."""
    w = along().rowsBetween(-n, n)
    sums = F.array(*[F.round(F.sum(F.col("probs")[k]).over(w), 9) for k in range(width)])
    return df.withColumn("sums", sums).withColumn("winner", F.array_position("sums", F.array_max("sums"))).drop("sums")


def fallback_stage(trips: DataFrame, stages: DataFrame, key: str) -> DataFrame:
    """Stages of each trip; a trip without any gets one stage of mode car over the whole trip with probability 0.1."""
    x = trips.join(stages, key, "left")
    none = F.col("mode").isNull()
    return x.select(
        key, F.coalesce("mode", F.lit("car")).alias("mode"), F.coalesce("start_t", "trip_start_t").alias("start_t"), F.coalesce("end_t", "trip_end_t").alias("end_t"),
        F.when(none, 0.1).otherwise(F.col("prob")).alias("prob"), F.when(none, "guessed").otherwise(F.col("model")).alias("model"),
    )


def reciprocal_rank(labels: Column, truth: Column) -> Column:
    """1 over the position of the true label in a ranked list, 0 if it is not there."""
    at = F.array_position(labels, truth)
    return F.when(at > 0, F.lit(1.0) / F.nullif(at, F.lit(0))).otherwise(0.0)


def mean_reciprocal_rank(df: DataFrame, labels: str, truth: str) -> DataFrame:
    """(mrr): the mean reciprocal rank of the true labels; rows with a null list or truth are left out, null without rows."""
    x = df.where(F.col(labels).isNotNull() & F.col(truth).isNotNull())
    return x.agg(F.avg(reciprocal_rank(F.col(labels), F.col(truth))).alias("mrr"))
