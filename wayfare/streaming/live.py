"""Streaming forms of batch operators: the same results as records arrive, with late data up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(stream: DataFrame, user: str, ts: str, gap: str = "60 minutes", late: str = "1 hour") -> DataFrame:
    """(user, start, end, n): stretches of a user's records without a gap of ``gap`` or more."""
    g = stream.withWatermark(ts, late).groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def window_stats(stream: DataFrame, user: str, ts: str, width: str = "300 seconds", step: str | None = None, late: str = "1 hour") -> DataFrame:
    """(user, start, n, first, last): per window the number of records and the first and last of them."""
    every = F.struct(*stream.columns)
    g = stream.withWatermark(ts, late).groupBy(user, F.window(ts, width, step).alias("w"))
    g = g.agg(F.count(F.lit(1)).alias("n"), F.min_by(every, ts).alias("first"), F.max_by(every, ts).alias("last"))
    return g.select(user, F.col("w.start").alias("start"), "n", "first", "last")


def once(stream: DataFrame, key: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Each record once, however often it arrives within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
