"""From the points of tracks to trips: gap split, detection by stops or by windows, fallback, merging with traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.operators import clusters, trajectory
from wayfare.operators.trajectory import along, inside_spans, mean_pair_speed
from wayfare.session import cut
from wayfare.settings import STUDY, Study

POINT = ("track", "part", "trip", "how", "id", "t", "lat", "lon")


def find_stops(points: DataFrame, study: Study = STUDY) -> DataFrame:
    """Stop clusters with the settings of a study; see ``clusters.stop_points``."""
    return clusters.stop_points(points, **study.stop)


def _parts(points: DataFrame, study: Study) -> DataFrame:
    """Points with ``whole``, their track, and as ``track`` the part of it between two gaps."""
    x = trajectory.gap_segments(points, study.gap_s)
    return x.withColumn("whole", F.col("track")).withColumn("track", F.concat("track", F.lit("#"), F.col("segment").cast("string")))


def by_stops(parts: DataFrame, stops: DataFrame, study: Study = STUDY) -> DataFrame:
    """(track, trip, id, t, lat, lon): points of the legs between stops that are fast enough on average."""
    x = cut(clusters.trip_points(parts, stops))
    fast = mean_pair_speed(x, ["track", "trip"]).where(F.col("kmh") > study.least_kmh)
    return x.join(fast.select("track", "trip"), ["track", "trip"], "left_semi").select("track", "trip", "id", "t", "lat", "lon")


def by_windows(parts: DataFrame, study: Study = STUDY) -> DataFrame:
    """(track, trip, id, t, lat, lon): points of the trips that moving windows begin and resting ones end."""
    found = trajectory.window_trips(parts, **study.window, noise=study.noise, least=study.least_points)
    at = parts.select("track", "id", "t")
    spans = found.join(at.withColumnsRenamed({"id": "start_id", "t": "a"}), ["track", "start_id"]).join(at.withColumnsRenamed({"id": "end_id", "t": "b"}), ["track", "end_id"])
    # The span of a trip is closed: a microsecond more on either side makes it open.
    spans = spans.select("track", "trip", (F.col("a") - 1).alias("a"), (F.col("b") + 1).alias("b"))
    return inside_spans(parts.select("track", "id", "t", "lat", "lon"), spans, ["track"]).select("track", "trip", "id", "t", "lat", "lon")


def merge_trips(legs: DataFrame, stops: DataFrame, within_us: int) -> DataFrame:
    """Legs (track, part, trip, how, id, t, lat, lon) of a track of which each starts less than ``within_us`` after the end
    reached so far become one trip, numbered from 0 per track. Between two legs of stops that are joined, the points of
    the stop between them come in too, but for its first and its last two (``stops``: part, stop, pos, id, t, lat, lon)."""
    key = ["track", "part", "trip", "how"]
    spans = legs.groupBy(*key).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    order = Window.partitionBy("track").orderBy("a", "b", "part", "trip")
    reached = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("fresh", F.coalesce((F.col("a") - reached >= within_us).cast("int"), F.lit(1)))
    spans = cut(spans.withColumn("no", (F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long")))
    own = legs.join(spans.select(*key, "no"), key).select("track", F.col("no").alias("trip"), "how", "id", "t", "lat", "lon")
    # A leg goes from stop k to stop k + 1; the stop between legs k and k + 1 is inside the trip if both are.
    two = spans.where("how = 'cluster'").select("track", "part", "trip", "no")
    joined = two.join(two.select("track", "part", (F.col("trip") - 1).alias("trip"), "no"), ["track", "part", "trip", "no"])
    joined = joined.select("track", "part", (F.col("trip") + 1).alias("stop"), "no")
    sized = stops.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("part", "stop"))).where("pos >= 1 and pos < size - 2")
    rest = joined.join(sized, ["part", "stop"]).select("track", F.col("no").alias("trip"), F.lit("cluster").alias("how"), "id", "t", "lat", "lon")
    return own.unionByName(rest).groupBy("track", "trip", "id", "t", "lat", "lon").agg(F.min("how").alias("how"))


def extract_trips(points: DataFrame, study: Study = STUDY, outliers: bool = True) -> DataFrame:
    """(track, trip, id, t, lat, lon, how): the points of every trip of the tracks.

    Positional outliers go first. Tracks are split at gaps; tracks of at least ``study.large`` points are cut into trips
    by stops, smaller ones by windows, and a track without a trip by the other way. Trips less than
    ``study.merge_within_s`` apart become one. Repeated points count once; an empty input gives no rows."""
    x = points.select("track", "id", "t", "lat", "lon").dropDuplicates(["track", "t", "lat", "lon"])
    x = cut(x)
    parts = cut(_parts(trajectory.without(x, trajectory.outliers(x)) if outliers else x, study))
    stops = cut(find_stops(parts, study))
    one = by_stops(parts, stops, study).withColumn("how", F.lit("cluster"))
    two = by_windows(parts, study).withColumn("how", F.lit("window"))
    large = parts.groupBy("whole").agg((F.count(F.lit(1)) >= study.large).alias("large"))
    both = one.unionByName(two).withColumn("part", F.col("track")).withColumn("whole", F.regexp_replace("track", "#[0-9]+$", "")).join(large, "whole")
    wanted = F.col("large") == (F.col("how") == "cluster")
    both = both.withColumn("any", F.max(wanted.cast("int")).over(Window.partitionBy("whole"))).where(wanted | (F.col("any") == 0))
    legs = cut(both.drop("track").withColumnRenamed("whole", "track").select(*POINT))
    return merge_trips(legs, stops.withColumnRenamed("track", "part"), study.merge_within_s * 1_000_000)


def trip_ends(points: DataFrame) -> DataFrame:
    """(track, trip, how, n, start_id, start_t, start_lat, start_lon, end_id, end_t, end_lat, end_lon) of trip points."""
    p = F.struct("t", "id", "lat", "lon")
    g = points.groupBy("track", "trip").agg(F.min("how").alias("how"), F.count(F.lit(1)).alias("n"), F.min(p).alias("a"), F.max(p).alias("b"))
    side = lambda e, name: [F.col(f"{e}.{c}").alias(f"{name}_{c}") for c in ("id", "t", "lat", "lon")]
    return g.select("track", "trip", "how", "n", *side("a", "start"), *side("b", "end"))


def trip_key(lat1, lon1, lat2, lon2):
    """The whole number that a trip's two ends are stored under: a product of weighted coordinates, modulo 2^31 - 1."""
    product = (F.lit(5.0) * lat1) * (F.lit(7.0) * lon1) * (F.lit(11.0) * lat2) * (F.lit(17.0) * lon2)
    return (product % F.lit(2147483647)).cast("int")


def merged_by_track(points: DataFrame, study: Study = STUDY) -> DataFrame:
    """The variant without a gap split: distinct points, outliers removed, stops first, windows where stops give no trip."""
    return extract_trips(points, Study(gap_s=10**9, large=0, stop=study.stop, window=study.window, noise=study.noise, least_points=study.least_points, merge_within_s=study.merge_within_s))


def numbered(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Add BIGINT ``out``: 0, 1, ... in order within a group, so that ids are known before rows are stored."""
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).cast("long"))


def deduplicated(trace: DataFrame) -> DataFrame:
    """A trace without points that repeat the one before in time and position."""
    w = along()
    same = F.struct("t", "lat", "lon").eqNullSafe(F.lag(F.struct("t", "lat", "lon")).over(w))
    return trace.withColumn("same", same).where(~F.col("same")).drop("same")
