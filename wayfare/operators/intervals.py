"""Overlapping and gapped intervals per entity: continuous periods, and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.operators.chunked import chunk_of, with_running_sums
from wayfare.session import cut


def periods_and_gaps(df: DataFrame, entity: str, start_us: str, stop_us: str, most_gap_us: int | None = None) -> DataFrame:
    """(entity, kind, from_us, to_us): each continuous period, and each gap between two successive ones.

    Starts and ends are ranked independently of each other per entity. Going through the instants in
    order, a period ends where as many ends as starts have been passed, that is where the next-ranked
    start lies beyond the current-ranked end; the k-th such start and the k-th such end make a period.
    Intervals that overlap or touch belong together. Rows with a null entity, start or stop, or whose
    stop is not later than the start, are left out; repeated rows change nothing. With ``most_gap_us``
    longer gaps are left out.

    Hot entities: boundaries are counted per (entity, instant) with map-side combining, ranked per
    (entity, day) with carried totals, and paired by rank in aggregates over two rows each.
    """
    rows = df.where(F.col(entity).isNotNull() & (F.col(stop_us) > F.col(start_us)))
    marks = rows.select(
        F.col(entity).alias("entity"),
        F.inline(
            F.array(
                F.struct(F.col(start_us).alias("at"), F.lit(1).alias("s"), F.lit(0).alias("e")),
                F.struct(F.col(stop_us).alias("at"), F.lit(0).alias("s"), F.lit(1).alias("e")),
            )
        ),
    )
    instants = (
        marks.groupBy("entity", "at")
        .agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
        .withColumn("chunk", chunk_of(F.col("at")))
    )
    instants = cut(instants)  # each pass below reads it twice
    ranked = with_running_sums(instants, ["entity"], "chunk", ["at"], {"starts": F.col("s"), "ends": F.col("e")})
    # Open before an instant: starts minus ends so far, without this instant's own.
    opens = (F.col("starts") - F.col("s")) == (F.col("ends") - F.col("e"))
    closes = F.col("starts") == F.col("ends")
    edges = ranked.select("entity", "chunk", "at", opens.alias("opens"), closes.alias("closes")).where("opens or closes")
    edges = cut(edges)
    numbered = with_running_sums(edges, ["entity"], "chunk", ["at"], {"no": F.col("opens").cast("long")})
    # The start of period k pairs with its end as period k, and with the end of k-1 as the gap before it.
    sides = numbered.select(
        "entity",
        F.inline(
            F.array(
                F.struct(F.lit("period").alias("kind"), F.col("no"), F.when(F.col("opens"), F.col("at")).alias("a"), F.when(F.col("closes"), F.col("at")).alias("b")),
                F.struct(F.lit("gap").alias("kind"), (F.col("no") - F.when(F.col("opens"), 1).otherwise(0)).alias("no"), F.when(F.col("closes"), F.col("at")).alias("a"), F.when(F.col("opens"), F.col("at")).alias("b")),
            )
        ),
    )
    paired = sides.groupBy("entity", "kind", "no").agg(F.max("a").alias("from_us"), F.max("b").alias("to_us"))
    found = paired.where("from_us is not null and to_us is not null")
    if most_gap_us is not None:
        found = found.where(f"kind = 'period' or to_us - from_us <= {int(most_gap_us)}")
    return found.select(F.col("entity").alias(entity), "kind", "from_us", "to_us")
