"""Features of acceleration sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.columns import let
from wayfare.functions.geo import norm3
from wayfare.operators.trajectory import along


def haar(values: Column, size: int) -> Column:
    """Orthonormal Haar transform of an array of ``size`` (a power of two): approximation, then details from coarse to fine."""
    if size & (size - 1) or size < 1:
        raise ValueError("size must be a power of two")

    def level(v: Column, n: int) -> Column:
        if n == 1:
            return v
        index = F.sequence(F.lit(0), F.lit(n // 2 - 1))
        pick = lambda sign: F.transform(index, lambda i: (F.get(v, i * 2) + sign * F.get(v, i * 2 + 1)) / F.lit(2**0.5))
        return F.concat(let(pick(1), lambda x: level(x, n // 2)), pick(-1))

    # Each level is bound before the next reads it; written out in one another, levels would be computed anew per element.
    return let(values, lambda v: level(v, size))


def sliding_norms(df: DataFrame, width: int) -> DataFrame:
    """(track, id, norms, label): every full window of ``width`` successive acceleration norms of a track, with the most
    common label in it (the smallest of equally common ones)."""
    w = along().rowsBetween(0, width - 1)
    x = df.withColumn("norm", norm3("x", "y", "z")).select(
        "track", "id", F.collect_list("norm").over(w).alias("norms"), F.collect_list("label").over(w).alias("labels")
    )
    x = x.where(F.size("norms") == width)
    votes = F.transform(F.array_distinct("labels"), lambda v: F.struct((-F.size(F.filter("labels", lambda y: y == v))).alias("n"), v.alias("v")))
    return x.select("track", "id", "norms", F.array_min(votes)["v"].alias("label"))


def activity_windows(df: DataFrame, width: int) -> DataFrame:
    """(track, id, mean): mean acceleration norm over each full window of ``width`` rows."""
    w = along().rowsBetween(0, width - 1)
    x = df.withColumn("norm", norm3("x", "y", "z"))
    x = x.select("track", "id", F.avg("norm").over(w).alias("mean"), F.count("norm").over(w).alias("n"))
    return x.where(F.col("n") == width).drop("n")
