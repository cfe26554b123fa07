"""Irregular readings onto a regular grid, with gaps filled within a limit or marked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.functions.columns import floor_div


def regular_grid(
    df: DataFrame,
    source: str,
    at_us: str,
    value: str,
    step_us: int = 60_000_000,
    recording_gap_us: int = 30 * 60_000_000,
    carry_us: int = 5 * 60_000_000,
) -> DataFrame:
    """(source, recording, bucket, readings, value, filled): one row per source and step of each recording.

    A recording goes on while successive readings of a source are at most ``recording_gap_us`` apart.
    ``bucket`` is the instant divided by ``step_us``. ``readings`` is 0 for a step without a reading;
    there ``value`` is the last step's mean carried forward over at most ``carry_us`` (``filled`` true),
    else null (``filled`` false). Rows with null source, instant or value (NaN counts as null) are left out.

    Readings are first reduced to one row per source and step with map-side combining. What is windowed
    per source then has at most one row per step of the calendar time covered, whatever the number of rows.
    """
    readings = df.where(F.col(source).isNotNull() & F.col(at_us).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    buckets = (
        readings.select(F.col(source).alias("source"), F.col(at_us).alias("at"), F.col(value).cast("double").alias("v"))
        .groupBy("source", floor_div(F.col("at"), step_us).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("readings"), F.avg("v").alias("mean"), F.min("at").alias("first"), F.max("at").alias("last"))
    )
    by_time = Window.partitionBy("source").orderBy("bucket")
    fresh = F.coalesce((F.col("first") - F.lag("last").over(by_time) > recording_gap_us).cast("int"), F.lit(1))
    numbered = buckets.withColumn("fresh", fresh).withColumn("recording", F.sum("fresh").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    # The sequence of steps of each recording, in stretches of one day so that no row holds an unbounded array.
    stretch = 86_400_000_000 // step_us or 1
    spans = (
        numbered.groupBy("source", "recording")
        # Asking for the same columns as the join below lets both read one exchange.
        .agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"), F.sum("readings").alias("n"), F.min("mean").alias("least"))
        .where("n > 0 and least is not null")
        .select("source", "recording", "lo", "hi", F.explode(F.sequence(floor_div(F.col("lo"), stretch), floor_div(F.col("hi"), stretch))).alias("k"))
        .select("source", "recording", F.greatest("lo", F.col("k") * stretch).alias("lo"), F.least("hi", F.col("k") * stretch + stretch - 1).alias("hi"))
    )
    steps = spans.select("source", "recording", F.explode(F.sequence("lo", "hi")).alias("bucket"))
    grid = steps.join(numbered.select("source", "recording", "bucket", "readings", "mean"), ["source", "recording", "bucket"], "left")
    along = Window.partitionBy("source", "recording").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("readings").isNotNull(), F.struct("bucket", "mean")), ignorenulls=True).over(along)
    fits = (F.col("bucket") - F.col("seen.bucket")) * step_us <= carry_us
    return (
        grid.withColumn("seen", seen)
        .select(
            F.col("source").alias(source),
            "recording",
            "bucket",
            F.when(F.col("mean").isNull(), 0).otherwise(F.col("readings")).alias("readings"),
            F.when(F.col("readings").isNotNull(), F.col("mean")).when(fits, F.col("seen.mean")).alias("value"),
            (F.col("readings").isNull() & fits).alias("filled"),
        )
    )
