"""Operators on trajectories: (track, id, t, lat, lon) rows ordered by t and id within a track.

A track is one device's day (see ``sources/tracks.py``), so windows partitioned by it are bounded by what a device
records in a day, whatever the number of devices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from wayfare.functions.columns import floor_div, scratch
from wayfare.functions.geo import bearing_deg, haversine_km, seconds_between, speed_kmh


def along(track: str = "track", t: str = "t", tie: str = "id") -> WindowSpec:
    return Window.partitionBy(track).orderBy(t, tie)


def pairs(df: DataFrame) -> DataFrame:
    """Every point that has a successor, with it: t2, lat2, lon2, whole seconds ``s`` and distance ``km``."""
    w = along()
    nx = df.withColumns({f"{c}2": F.lead(c).over(w) for c in ("t", "lat", "lon")}).where("t2 is not null")
    return nx.withColumns({"s": seconds_between(F.col("t"), F.col("t2")), "km": haversine_km("lat", "lon", "lat2", "lon2")})


def triples(df: DataFrame) -> DataFrame:
    """Every inner point b with its neighbours a and c as structs."""
    w, here = along(), F.struct("t", "lat", "lon")
    return df.withColumns({"a": F.lag(here).over(w), "b": here, "c": F.lead(here).over(w)}).where("a is not null and c is not null")


def _km(p: str, q: str) -> Column:
    return haversine_km(f"{p}.lat", f"{p}.lon", f"{q}.lat", f"{q}.lon")


def outliers(df: DataFrame, straight_deg: float = 5.0, within_s: int = 90, least_km: float = 0.1, near_km: float = 0.1, fast_kmh: float = 30.0) -> DataFrame:
    """The rows that are positional outliers between their neighbours: a spike back and forth within a short time, or
    two fast hops that end up near where they began. All triples are judged on the original sequence."""
    x = triples(df).withColumns(
        {
            "v1": speed_kmh(_km("a", "b"), seconds_between(F.col("a.t"), F.col("b.t"))),
            "v2": speed_kmh(_km("b", "c"), seconds_between(F.col("b.t"), F.col("c.t"))),
            "turn": F.abs(F.abs(bearing_deg("a.lat", "a.lon", "b.lat", "b.lon") - bearing_deg("b.lat", "b.lon", "c.lat", "c.lon")) - 180.0),
            "d12": _km("a", "b"),
            "d13": _km("a", "c"),
            "span": seconds_between(F.col("a.t"), F.col("c.t")),
        }
    )
    back = (F.col("turn") <= straight_deg) & (F.col("span") <= within_s) & (F.col("d12") >= least_km)
    dash = (F.col("d13") <= near_km) & (F.col("v1") >= fast_kmh) & (F.col("v2") >= fast_kmh)
    return x.where(back | dash).select(*df.columns)


def without(df: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti").select(*df.columns)


def dedup_consecutive(df: DataFrame) -> DataFrame:
    """Rows whose position differs from that of the row before."""
    w = along()
    same = (F.lag("lat").over(w) == F.col("lat")) & (F.lag("lon").over(w) == F.col("lon"))
    return df.withColumn("same", F.coalesce(same, F.lit(False))).where(~F.col("same")).drop("same")


def tidy(df: DataFrame, least_m: float, least_s: int) -> DataFrame:
    """Points whose successor is at least ``least_m`` metres and ``least_s`` seconds away, and each track's last point."""
    w = along()
    nx = df.withColumns({f"{c}2": F.lead(c).over(w) for c in ("t", "lat", "lon")})
    metres, seconds = haversine_km("lat", "lon", "lat2", "lon2") * 1000.0, seconds_between(F.col("t"), F.col("t2"))
    return nx.where(F.col("t2").isNull() | ((metres >= least_m) & (seconds >= least_s))).select(*df.columns)


def gap_segments(df: DataFrame, gap_s: int) -> DataFrame:
    """Add ``segment``, counted from 0 per track; a new one begins after more than ``gap_s`` seconds."""
    w = along()
    cut = F.coalesce((F.col("t") - F.lag("t").over(w) > gap_s * 1_000_000).cast("int"), F.lit(0))
    return df.withColumn("cut", cut).withColumn("segment", F.sum("cut").over(w).cast("long")).drop("cut")


def path_stats(df: DataFrame, group: list[str]) -> DataFrame:
    """Per group: points n, start and end t, path length km, mean speed kmh of length over time (0 if no time passed)."""
    w = Window.partitionBy(*group).orderBy("t", "id")
    hop = haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon")
    g = df.withColumn("hop", hop).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.coalesce(F.sum("hop"), F.lit(0.0)).alias("km")
    )
    return g.withColumn("kmh", speed_kmh("km", seconds_between(F.col("start_t"), F.col("end_t"))))


def mean_pair_speed(df: DataFrame, group: list[str]) -> DataFrame:
    """Per group the running mean of the speeds between successive points; null for a single point. A pair within
    one second counts as the infinite or undefined speed it has, given as null."""
    w = Window.partitionBy(*group).orderBy("t", "id")
    s = seconds_between(F.lag("t").over(w), F.col("t"))
    v = haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon") * 1000.0 / F.nullif(s, F.lit(0)) * 3.6
    g = df.withColumns({"v": v, "s": s}).groupBy(*group).agg(F.avg("v").alias("v"), F.max((F.col("s") == 0).cast("int")).alias("z"))
    return g.select(*group, F.when(F.coalesce(F.col("z"), F.lit(0)) == 0, F.col("v")).alias("kmh"))


def tumbling_stats(df: DataFrame, seconds: int, strict: bool = False) -> DataFrame:
    """Per track and window of ``seconds``: n, first and last point, degrees and km between them, path km, mean kmh.
    Windows are half-open; with ``strict`` points exactly on a boundary are left out."""
    width = seconds * 1_000_000
    x = df.withColumn("win", F.col("t") - F.pmod(F.col("t"), F.lit(width)))
    if strict:
        x = x.where(F.col("t") != F.col("win"))
    w = Window.partitionBy("track", "win").orderBy("t", "id")
    x = x.withColumn("hop", haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon"))
    p = F.struct("t", "id", "lat", "lon")
    g = x.groupBy("track", "win").agg(F.count(F.lit(1)).alias("n"), F.min(p).alias("a"), F.max(p).alias("b"), F.coalesce(F.sum("hop"), F.lit(0.0)).alias("path_km"))
    dl, dn = F.col("b.lat") - F.col("a.lat"), F.col("b.lon") - F.col("a.lon")
    return g.select(
        "track", "win", "n", F.col("a.id").alias("first_id"), F.col("b.id").alias("last_id"), F.sqrt(dl * dl + dn * dn).alias("degrees"),
        _km("a", "b").alias("km"), "path_km", speed_kmh("path_km", seconds_between(F.col("a.t"), F.col("b.t"))).alias("kmh"),
    )


def day_windows(df: DataFrame, window_s: int, step_s: int, threshold_km: float, full: bool = False) -> DataFrame:
    """Overlapping windows over the second of the day: (track, k, first_id, last_id, moving).

    Window k holds the points from second k to k plus the lesser of window and step, both ends included
    (``full``: the whole window); it moves if its ends are at least ``threshold_km`` apart.
    """
    day_us = 86_400_000_000
    sod = F.pmod(F.col("t"), F.lit(day_us))
    width = window_s if full else min(window_s, step_s)
    step, reach = step_s * 1_000_000, width * 1_000_000
    last_k = (86400 - window_s - 1) // step_s
    lo = F.greatest(F.lit(0), F.ceil((sod - reach) / F.lit(step)).cast("long"))
    hi = F.least(F.lit(last_k), F.floor(sod / F.lit(step)).cast("long"))
    x = df.withColumn("sod", sod).withColumns({"lo": lo, "hi": hi}).where("lo <= hi")
    x = x.withColumn("k", F.explode(F.sequence("lo", "hi")))
    p = F.struct("t", "id", "lat", "lon")
    g = x.groupBy("track", "k").agg(F.min(p).alias("a"), F.max(p).alias("b"))
    return g.select("track", (F.col("k") * step_s).alias("k"), F.col("a.id").alias("first_id"), F.col("b.id").alias("last_id"), (_km("a", "b") >= threshold_km).alias("moving"))


def window_trips(df: DataFrame, window_s: int, step_s: int, threshold_km: float, noise: int, least: int, emit_open: bool = False) -> DataFrame:
    """Trips (track, trip, start_id, end_id, n) by a state machine over points that begin moving or resting windows.

    At rest, a point that begins a moving window starts a trip. On a trip, a point that begins a resting window
    is tolerated ``noise`` times in all (the count is not reset); the next ends the trip and is not part of it. A trip
    still open at the end is dropped unless ``emit_open``. Only trips of more than ``least`` points are kept. A first
    point that begins no window counts as at rest. The fold runs in the JVM over one track, a day, at a time.
    """
    first = day_windows(df, window_s, step_s, threshold_km).groupBy("track", F.col("first_id").alias("id")).agg(F.min_by("moving", "k").alias("moving"))
    cat = F.when(F.col("moving"), 1).when(~F.col("moving"), 0).otherwise(-1)
    marked = df.select("track", "id", "t").join(first, ["track", "id"], "left").withColumn("cat", cat)
    days = marked.groupBy("track").agg(F.sort_array(F.collect_list(F.struct("t", "id", "cat"))).alias("points"))
    none = F.lit(None).cast("long")
    trip = "struct<a:bigint,b:bigint,n:int>"
    start = F.struct(
        F.lit(False).alias("on"), F.lit(0).alias("noise"), none.alias("a"), none.alias("b"), F.lit(0).alias("n"), F.array().cast(f"array<{trip}>").alias("done")
    )

    def step(s: Column, p: Column) -> Column:
        ends = s["on"] & (p["cat"] == 0) & (s["noise"] > noise)
        starts = ~s["on"] & (p["cat"] == 1)
        goes = s["on"] & ~ends
        done = F.when(ends, F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"), s["n"].alias("n"))))).otherwise(s["done"])
        return F.struct(
            (goes | starts).alias("on"),
            F.when(goes & (p["cat"] == 0), s["noise"] + 1).when(goes, s["noise"]).otherwise(0).alias("noise"),
            F.when(starts, p["id"]).when(goes, s["a"]).otherwise(none).alias("a"),
            F.when(starts | goes, p["id"]).otherwise(none).alias("b"),
            F.when(starts, 1).when(goes, s["n"] + 1).otherwise(0).alias("n"),
            done.alias("done"),
        )

    folded = days.select("track", F.aggregate("points", start, step).alias("s"))
    done = F.col("s.done")
    if emit_open:
        done = F.when(F.col("s.on"), F.concat(done, F.array(F.struct(F.col("s.a").alias("a"), F.col("s.b").alias("b"), F.col("s.n").alias("n"))))).otherwise(done)
    trips = folded.select("track", F.posexplode(F.filter(done, lambda x: x["n"] > least)).alias("trip", "x"))
    return trips.select("track", F.col("trip").cast("long").alias("trip"), F.col("x.a").alias("start_id"), F.col("x.b").alias("end_id"), F.col("x.n").cast("long").alias("n"))


# Microseconds of the units that a calendar can be split by.
UNITS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}


def calendar_part(t: Column, value: int, unit: str) -> Column:
    """The start, in microseconds, of the stretch of ``value`` units that ``t`` falls in, counted from 1970 on."""
    if unit not in UNITS or value < 1:
        raise ValueError(f"cannot split by {value} {unit}")
    return t - F.pmod(t, F.lit(value * UNITS[unit]))


def calendar_counts(df: DataFrame, t: str, value: int, unit: str, strict: bool = False, empty: bool = False) -> DataFrame:
    """(start_t, n): rows per stretch of ``value`` units. Stretches are half-open; with ``strict`` rows exactly on a
    boundary are left out. With ``empty`` stretches without rows between the first and the last are given too."""
    part = calendar_part(F.col(t), value, unit)
    x = df.where(F.col(t).isNotNull())
    g = (x.where(F.col(t) != part) if strict else x).groupBy(part.alias("start_t")).agg(F.count(F.lit(1)).alias("n"))
    if not empty:
        return g
    every = g.agg(F.sequence(F.min("start_t"), F.max("start_t"), F.lit(value * UNITS[unit])).alias("s")).select(F.explode("s").alias("start_t"))
    return every.join(g, "start_t", "left").select("start_t", F.coalesce("n", F.lit(0)).alias("n"))


def clock_of(seconds: Column, day: str = "2018-06-03") -> Column:
    """The TIMESTAMP_NTZ at ``seconds`` of the day, on a fixed day."""
    return F.to_timestamp_ntz(F.lit(day + " 00:00:00")) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def inside_spans(rows: DataFrame, spans: DataFrame, keys: list[str], width_us: int = 3_600_000_000) -> DataFrame:
    """Rows (keys, t, ...) strictly inside spans (keys, a, b, ...) of the same keys, with the columns of both.

    A span is put into every stretch of ``width_us`` that it touches and rows are joined on (keys, stretch), so that
    only rows and spans of one stretch are compared and a hot key is spread over its time. Nulls match nothing."""
    (part,) = scratch(rows, 1, also=tuple(spans.columns))
    at = lambda c: floor_div(F.col(c), width_us)
    s = spans.where("a <= b").withColumn(part, F.explode(F.sequence(at("a"), at("b"))))
    return rows.withColumn(part, at("t")).join(s, [*keys, part]).where("t > a and t < b").drop(part)


def merge_intervals_within(df: DataFrame, key: str, start: str, end: str, within_us: int) -> DataFrame:
    """Chains of intervals of a key, each starting less than ``within_us`` after the end reached so far, as one:
    (key, start, end, n)."""
    w = Window.partitionBy(key).orderBy(start, end)
    reached = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col(start) - reached >= within_us).cast("int"), F.lit(1))
    x = df.withColumn("fresh", fresh).withColumn("chain", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(key, "chain").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("chain")
