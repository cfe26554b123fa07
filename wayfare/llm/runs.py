"""Runs of the same event in ordered sequences, collapsed into one event each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.operators.chunked import chunk_of


def label_key(label: Column) -> Column:
    """What makes labels the same: their letters a-z without regard to case; null if there are none."""
    return F.nullif(F.regexp_replace(F.lower(label), "[^a-z]", ""), F.lit(""))


def collapse_runs(
    df: DataFrame, sequence: str, event: str, label: str, start: str, end: str, slack_us: int = 120_000_000
) -> DataFrame:
    """(sequence, key, first_event, last_event, n, start_us, end_us, duration_us): one row per run.

    In order of ``start``, then ``event``, successive events of a sequence with the same label key form a
    run as long as each starts at most ``slack_us`` after the latest end so far in the run. A label
    without letters, or null, is the same as nothing. A missing end counts as the start. Rows with a null
    sequence or start are left out; runs of one event are given too, with n = 1. ``start`` and ``end``
    are BIGINT microseconds.

    Only boundary rows go on: those that differ from their predecessor. The lead over them gives each
    run's count from the difference of positions and its last event and end from the row before the next
    boundary. Sequences are windowed per (sequence, day); what a day needs of the days before (position,
    last label, the latest end under that label) is carried over from one row per (sequence, day), so
    that a sequence holding a third of all rows is spread over its days.
    """
    rows = df.where(F.col(sequence).isNotNull() & F.col(start).isNotNull()).select(
        F.col(sequence).alias("seq"), F.col(event).alias("ev"), label_key(F.col(label)).alias("key"),
        F.col(start).alias("s"), F.coalesce(F.col(end), F.col(start)).alias("e"), chunk_of(F.col(start)).alias("chunk"),
    )
    near = Window.partitionBy("seq", "chunk").orderBy("s", "ev")
    back = near.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"rn": F.row_number().over(near), "prev": F.lag(F.struct("key", "ev")).over(near)})
    changed = F.coalesce(F.col("prev.key") != F.col("key"), F.lit(True))
    # Stretches of one label within the day; 0 is the stretch that may go on from the day before.
    rows = rows.withColumn("stretch", F.sum((changed & (F.col("rn") > 1)).cast("int")).over(back))
    # Both uses of these rows read one exchange by (sequence, day), and no window or join below moves them again.
    # Per day: its first label, its last label with the latest end under it, and its number of rows.
    last = F.struct("rn", "key", "ev", "stretch")
    ends = rows.groupBy("seq", "chunk", "stretch").agg(F.max("e").alias("e"), F.min(F.struct("rn", "key")).alias("head"), F.max(last).alias("tail"))
    days = ends.groupBy("seq", "chunk").agg(
        F.min_by("head", "stretch").alias("head"), F.max_by("tail", "stretch").alias("tail"), F.max_by("e", "stretch").alias("e"), F.max("stretch").alias("stretches")
    )
    far = Window.partitionBy("seq").orderBy("chunk")
    so_far = far.rowsBetween(Window.unboundedPreceding, -1)
    # A day joined to the day before by its only stretch passes that day's latest end on.
    whole = (F.col("stretches") == 0) & F.coalesce(F.lag("tail.key").over(far) == F.col("head.key"), F.lit(False))
    days = days.withColumn("link", F.sum((~whole).cast("int")).over(far.rowsBetween(Window.unboundedPreceding, 0)))
    passed = Window.partitionBy("seq", "link").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("latest", F.max("e").over(passed))
    days = days.select(
        "seq", "chunk", F.coalesce(F.sum("tail.rn").over(so_far), F.lit(0)).alias("before_n"), F.lag("tail").over(far).alias("before"),
        F.lag("latest").over(far).alias("before_e"), (F.lead("chunk").over(far).isNull()).alias("final"), F.col("tail.rn").alias("size"),
    )
    rows = rows.join(days, ["seq", "chunk"])
    key_before = F.when(F.col("rn") == 1, F.col("before.key")).otherwise(F.col("prev.key"))
    ev_before = F.when(F.col("rn") == 1, F.col("before.ev")).otherwise(F.col("prev.ev"))
    in_stretch = Window.partitionBy("seq", "chunk", "stretch").orderBy("s", "ev").rowsBetween(Window.unboundedPreceding, -1)
    own = F.max("e").over(in_stretch)
    rows = rows.withColumns({"kb": key_before, "eb": ev_before, "own": own})
    goes_on = F.coalesce(F.col("kb") == F.col("key"), F.lit(False))
    # Earlier days' ends count only while this day's first stretch goes on from them.
    from_before = (F.col("stretch") == 0) & F.coalesce(F.col("before.key") == F.col("key"), F.lit(False))
    latest = F.greatest("own", F.when(from_before, F.col("before_e")))
    rows = rows.withColumn("boundary", ~goes_on | F.coalesce(F.col("s") > latest + slack_us, F.lit(True)))
    here = Window.partitionBy("seq", "chunk", "stretch").orderBy("s", "ev").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("reached", F.greatest(F.max("e").over(here), F.when(from_before, F.col("before_e"))))
    rows = rows.withColumn("end_before", F.when(F.col("rn") == 1, F.col("before_e")).otherwise(F.lag("reached").over(near)))
    position = F.col("before_n") + F.col("rn")
    finish = F.col("final") & (F.col("rn") == F.col("size"))
    # Boundary rows, and the end of each sequence as the boundary after the last.
    marks = rows.where(F.col("boundary") | finish).select(
        "seq", "chunk",
        F.inline(
            F.filter(
                F.array(
                    F.when(F.col("boundary"), F.struct(position.alias("at"), F.col("ev").alias("ev"), F.col("key").alias("key"), F.col("s").alias("s"), F.col("eb").alias("ev_before"), F.col("end_before").alias("end_before"))),
                    F.when(finish, F.struct((position + 1).alias("at"), F.lit(None).cast(dict(rows.dtypes)["ev"]).alias("ev"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("s"), F.col("ev").alias("ev_before"), F.col("reached").alias("end_before"))),
                ),
                lambda m: m.isNotNull(),
            )
        ),
    )
    order = Window.partitionBy("seq", "chunk").orderBy("at")
    first_of_day = Window.partitionBy("seq").orderBy("chunk")
    marks = marks.withColumn("next", F.lead(F.struct("at", "ev_before", "end_before")).over(order))
    starts = marks.groupBy("seq", "chunk").agg(F.min(F.struct("at", "ev_before", "end_before")).alias("head"))
    starts = starts.select("seq", "chunk", F.lead("head").over(first_of_day).alias("next_day"))
    runs = marks.join(starts, ["seq", "chunk"]).withColumn("next", F.coalesce("next", "next_day")).where("ev is not null")
    return runs.select(
        F.col("seq").alias(sequence), "key", F.col("ev").alias("first_event"), F.col("next.ev_before").alias("last_event"),
        (F.col("next.at") - F.col("at")).alias("n"), F.col("s").alias("start_us"),
        F.col("next.end_before").alias("end_us"), (F.col("next.end_before") - F.col("s")).alias("duration_us"),
    )
