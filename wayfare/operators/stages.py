"""Projecting mode changes onto a trace, and building single-mode stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.functions.columns import scratch
from wayfare.functions.geo import bearing_deg, destination, haversine_km
from wayfare.operators.trajectory import along, inside_spans


def transition_points(trace: DataFrame, changes: DataFrame, default: str = "car") -> DataFrame:
    """Points (track, t, lat, lon, mode) at which the mode along a trace changes, the first point included.

    ``changes`` are compressed modes (track, t, mode). Between two points of the trace: no change keeps the mode last
    seen before the first (the first mode of all if there is none, ``default`` for a track without modes); one change
    splits the hop at the change's share of its time; of two or more, each split carries the mode before it and the
    mode of the last is not seen within the hop. All comparisons are strict; runs of one mode are then compressed.
    """
    w = along()
    nx = trace.withColumns({f"{c}2": F.lead(c).over(w) for c in ("t", "lat", "lon")})
    hop = F.struct("id", "t", "lat", "lon", "t2", "lat2", "lon2")
    change = F.struct("t", "mode")
    points = nx.select("track", "t", F.lit(0).alias("side"), "id", hop.alias("hop"), F.lit(None).cast("struct<t:bigint,mode:string>").alias("change"))
    known = changes.where("track is not null and t is not null").select("track", "t", F.lit(1).alias("side"), F.lit(None).cast("long").alias("id"), F.lit(None).alias("hop"), change.alias("change"))
    # One sort of points and changes together, each change beside the hop it falls in: no list of a whole track's changes per hop.
    o = Window.partitionBy("track").orderBy("t", "side", "id", "change.mode")
    back, whole = o.rowsBetween(Window.unboundedPreceding, 0), o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = points.unionByName(known).withColumns({"at": F.sum(1 - F.col("side")).over(back), "last": F.last("change", ignorenulls=True).over(back), "c0": F.first("change", ignorenulls=True).over(whole)})
    # A change at the time of a point is in no hop, as one before the first point is in none.
    x = x.withColumn("from", F.last("hop", ignorenulls=True).over(back)["t"])
    inner = F.when((F.col("side") == 1) & (F.col("from") < F.col("t")), F.col("change"))
    own = F.when(F.col("side") == 0, F.struct("hop", "last", "c0"))
    x = x.groupBy("track", "at").agg(F.max(own).alias("own"), F.sort_array(F.collect_list(inner)).alias("inside"))
    x = x.select("track", "own.hop.*", "own.last", "own.c0", "inside").where("t2 is not null")
    before, first = F.col("last")["mode"], F.col("c0")["mode"]
    n = F.size("inside")

    def at(e: Column) -> tuple[Column, Column]:
        share = (e["t"] - F.col("t")) / (F.col("t2") - F.col("t"))
        km = haversine_km("lat", "lon", "lat2", "lon2")
        return destination(F.col("lat"), F.col("lon"), bearing_deg("lat", "lon", "lat2", "lon2"), km * share)

    def point(t: Column, lat: Column, lon: Column, mode: Column, k: Column) -> Column:
        return F.struct(t.alias("t"), k.cast("int").alias("k"), lat.alias("lat"), lon.alias("lon"), mode.alias("mode"))

    here = lambda mode: point(F.col("t"), F.col("lat"), F.col("lon"), mode, F.lit(0))
    one = F.col("inside")[0]
    many = F.transform(
        F.slice("inside", 2, F.greatest(n - 1, F.lit(0))),
        lambda e, i: point(e["t"], *at(e), F.when(i + 2 < n, F.get(F.col("inside"), i + 1)["mode"]).otherwise(F.get(F.col("inside"), i)["mode"]), i + 1),
    )
    points = (
        F.when(F.col("c0").isNull(), F.array(here(F.lit(default))))
        .when(n == 0, F.array(here(F.coalesce(before, first))))
        .when(n == 1, F.array(here(F.coalesce(before, one["mode"])), point(one["t"], *at(one), one["mode"], F.lit(1))))
        .otherwise(F.concat(F.array(here(one["mode"])), many))
    )
    p = x.select("track", "id", F.inline(points))
    o = Window.partitionBy("track").orderBy("t", "id", "k")
    changed = ~F.lag("mode").over(o).eqNullSafe(F.col("mode")) | (F.row_number().over(o) == 1)
    return p.withColumn("changed", changed).where("changed").select("track", "t", "lat", "lon", "mode")


def stages(points: DataFrame, ends: DataFrame, keep_last: bool = True) -> DataFrame:
    """(track, stage, mode, start_t, end_t, lat, lon, end_lat, end_lon) between successive transition points; the last stage reaches to the end of
    its track (``ends``: track, end_t and, if known, end_lat, end_lon), or is dropped with ``keep_last`` false where there are two or more points."""
    w = Window.partitionBy("track").orderBy("t", "mode")
    where = [F.col(c) if c in ends.columns else F.lit(None).cast("double").alias(c) for c in ("end_lat", "end_lon")]
    ends = ends.select("track", "end_t", F.struct(*where).alias("goal"))
    x = points.withColumns({"next": F.lead("t").over(w), "to": F.lead(F.struct(F.col("lat").alias("end_lat"), F.col("lon").alias("end_lon"))).over(w), "stage": F.row_number().over(w) - 1, "points": F.count(F.lit(1)).over(Window.partitionBy("track"))})
    x = x.join(ends, "track")
    if not keep_last:
        x = x.where(F.col("next").isNotNull() | (F.col("points") == 1))
    return x.select("track", F.col("stage").cast("long").alias("stage"), "mode", F.col("t").alias("start_t"), F.coalesce("next", "end_t").alias("end_t"), "lat", "lon", F.coalesce("to", "goal").alias("to")).select("*", "to.*").drop("to")


def stage_confidence(stage: DataFrame, probs: DataFrame) -> DataFrame:
    """Add ``confidence``: the mean probability of the rows of ``probs`` within a stage, both ends included, whose mode
    is the stage's; 0 where there are none.

    The mean is a difference of running sums: the rows of a track and mode are sorted once together with a mark at the
    start and one at the end of each stage, so nothing is joined by range. Sums are decimal, so that no digit is lost in
    the difference. A null or NaN probability is left out."""
    key, n, total = scratch(stage, 3)
    marks = stage.withColumn(key, F.struct(*[F.col(f"`{c}`") for c in stage.columns]))
    mark = lambda t, side: F.struct(F.col(t).alias("t"), F.lit(side).alias("side"))
    marks = marks.select(F.col("track"), F.col("mode"), F.inline(F.array(mark("start_t", 0), mark("end_t", 2))), F.lit(None).cast("decimal(18,12)").alias("p"), key)
    rows = probs.where(F.col("prob").isNotNull() & ~F.isnan("prob")).select("track", "mode", "t", F.lit(1).alias("side"), F.col("prob").cast("decimal(18,12)").alias("p"))
    every = marks.unionByName(rows, allowMissingColumns=True)
    so_far = Window.partitionBy("track", "mode").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumns({n: F.count("p").over(so_far), total: F.coalesce(F.sum("p").over(so_far), F.lit(0))}).where("side <> 1")
    sign = F.col("side") - 1  # minus what came before the start, plus what came up to the end
    g = every.groupBy(key).agg(F.sum(sign * F.col(n)).alias(n), F.sum(sign * F.col(total)).alias(total), F.count(F.lit(1)).alias("copies"))
    copies = F.explode(F.array_repeat(F.lit(0), (F.col("copies") / 2).cast("int")))  # equal stages stay as many rows
    mean = F.when(F.col(n) > 0, F.col(total).cast("double") / F.nullif(F.col(n), F.lit(0))).otherwise(0.0)
    return g.select(F.col(key), mean.alias("confidence"), copies.alias(n)).select(f"{key}.*", "confidence")


def stage_traces(stage: DataFrame, trace: DataFrame) -> DataFrame:
    """Add ``trace``, an array of (t, lat, lon): the stage's start position, the points of the track strictly within the
    stage, its end position. ``stage`` holds (track, stage, start_t, end_t, lat, lon, end_lat, end_lon)."""
    spans = stage.select("track", "stage", F.col("start_t").alias("a"), F.col("end_t").alias("b"))
    inner = inside_spans(trace.select("track", "t", "id", "lat", "lon"), spans, ["track"])
    inner = inner.groupBy("track", "stage").agg(F.sort_array(F.collect_list(F.struct("t", "id", "lat", "lon"))).alias("inner"))
    point = lambda t, lat, lon: F.array(F.struct(F.col(t).alias("t"), F.col(lat).alias("lat"), F.col(lon).alias("lon")))
    middle = F.transform(F.coalesce("inner", F.array().cast("array<struct<t:bigint,id:bigint,lat:double,lon:double>>")), lambda p: F.struct(p["t"].alias("t"), p["lat"].alias("lat"), p["lon"].alias("lon")))
    x = stage.join(inner, ["track", "stage"], "left")
    return x.withColumn("trace", F.concat(point("start_t", "lat", "lon"), middle, point("end_t", "end_lat", "end_lon"))).drop("inner")


def widen_ends(stage: DataFrame, samples: DataFrame) -> DataFrame:
    """(trip_id, stage_id, start_us, end_us): the first stage of a trip starts with the trip's first sample and the last
    ends with its last, by ``samples`` (trip_id, lo, hi); a trip without samples keeps its own. Stages are in order of
    start, then id; ``stage`` holds (trip_id, stage_id, start_us, end_us)."""
    w = Window.partitionBy("trip_id").orderBy("start_us", "stage_id")
    back = Window.partitionBy("trip_id").orderBy(F.desc("start_us"), F.desc("stage_id"))
    x = stage.withColumns({"first": F.row_number().over(w) == 1, "final": F.row_number().over(back) == 1}).join(samples, "trip_id", "left")
    start = F.when(F.col("first"), F.coalesce("lo", "start_us")).otherwise(F.col("start_us"))
    end = F.when(F.col("final"), F.coalesce("hi", "end_us")).otherwise(F.col("end_us"))
    return x.select("trip_id", "stage_id", start.alias("start_us"), end.alias("end_us"))
