"""Trajectories, accelerations, mode sequences and trips of the real tables, one track per device and day.

``day_tracks`` goes by the time of arrival, a TIMESTAMP, so that the same expressions can be given as SQL and every
operator on tracks be compared with a query of another engine; ``instant_tracks`` goes by the instant that the
written timestamp denotes. A track holds what one device records in one UTC day, whatever the number of users.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.geo import norm3
from wayfare.functions.timestamps import compact_utc_us
from wayfare.sources.tables import locations, table

# Modes by the letters of their labels; other labels are no mode.
MODES = {"walk": "walk", "bike": "bike", "ebike": "bike", "car": "car", "bus": "bus", "train": "train", "still": "still"}
# Upper bounds, in m/s^2 beside gravity, of the kinds of movement that accelerations are labelled with.
SHAKES = {"still": 0.5, "walk": 2.0, "bus": 5.0}
GRAVITY = 9.81


def track_of(user: Column, t_us: Column) -> Column:
    """A device's UTC day, as text."""
    return F.concat(user, F.lit("/"), F.date_format(F.timestamp_micros(t_us), "yyyy-MM-dd"))


def _sensible() -> Column:
    lat, lon = F.col("point.latitude"), F.col("point.longitude")
    return lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)) & (F.col("accuracy") > 0) & (F.col("accuracy") <= 200)


def day_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """(track, id, t BIGINT microseconds, lat, lon) by time of arrival: fixes with a sensible position and accuracy."""
    t = F.unix_micros(F.col("received_at").cast("timestamp"))
    rows = table(spark, folder, "locationeventpertime").where(_sensible() & F.col("received_at").isNotNull() & F.col("user_id").isNotNull())
    return rows.select(track_of(F.col("user_id"), t).alias("track"), F.col("event_id").alias("id"), t.alias("t"), F.col("point.latitude").alias("lat"), F.col("point.longitude").alias("lon"))


def instant_tracks(spark: SparkSession, folder: str, day: str | None = None, users: DataFrame | None = None) -> DataFrame:
    """(track, id, t, lat, lon) by the instant written; repeats of a fix count once. ``day`` (yyyyMMdd, the local day)
    reaches the scan; ``users`` (user_id) is a semi join."""
    rows = locations(spark, folder).where(_sensible() & F.col("user_id").isNotNull())
    if day is not None:
        rows = rows.where(F.col("day") == day)
    if users is not None:
        rows = rows.join(users.select("user_id"), "user_id", "left_semi")
    t = F.col("instant_us")
    x = rows.where(t.isNotNull()).select(track_of(F.col("user_id"), t).alias("track"), "event_id", t.alias("t"), F.col("point.latitude").alias("lat"), F.col("point.longitude").alias("lon"))
    return x.groupBy("track", "t", "lat", "lon").agg(F.min("event_id").alias("id")).select("track", "id", "t", "lat", "lon")


def _mode() -> Column:
    letters = F.regexp_replace(F.lower("label"), "[^a-z]", "")
    return F.element_at(F.create_map(*[F.lit(x) for kv in MODES.items() for x in kv]), letters)


def mode_sequence(spark: SparkSession, folder: str) -> DataFrame:
    """(track, id, t, mode, prob): the predicted mode from each stage's start on. Stages of no known mode are left out; of
    several that start at one instant the one with the smallest id counts."""
    s = table(spark, folder, "predictedstage").where("starttimestamp is not null")
    who = table(spark, folder, "trip").where("citizen_id is not null").select("trip_id", "citizen_id")
    t = F.unix_micros(F.col("starttimestamp").cast("timestamp"))
    x = s.withColumn("mode", _mode()).where("mode is not null").join(who, "trip_id")
    x = x.select(track_of(F.col("citizen_id"), t).alias("track"), F.col("stage_id").alias("id"), t.alias("t"), "mode", F.coalesce("prob", F.lit(0.0)).alias("prob"))
    first = F.min(F.struct("id", "mode", "prob")).alias("s")
    return x.groupBy("track", "t").agg(first).select("track", "s.id", "t", "s.mode", "s.prob")


def sensor_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(track, id, t, x, y, z, label): possible accelerations, labelled by how far their length is from gravity."""
    t = compact_utc_us(F.col("timestamp"))
    a = table(spark, folder, "accelerometerevent").where("abs(x) <= 160 and abs(y) <= 160 and abs(z) <= 160 and user_id is not null")
    a = a.select("user_id", F.col("event_id").alias("id"), F.inline(F.array(F.struct(t.alias("t")))), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    beside, label = F.abs(norm3("x", "y", "z") - GRAVITY), F.lit("bike")
    for name, most in reversed(SHAKES.items()):
        label = F.when(beside < most, name).otherwise(label)
    return a.where("t is not null").select(track_of(F.col("user_id"), F.col("t")).alias("track"), "id", "t", "x", "y", "z", label.alias("label"))


def stage_trips(spark: SparkSession, folder: str) -> DataFrame:
    """(user, trip_id, a, b): from the first start to the last end of each trip's stages, in microseconds."""
    s = table(spark, folder, "predictedstage").where("starttimestamp is not null")
    who = table(spark, folder, "trip").where("citizen_id is not null").select("trip_id", F.col("citizen_id").alias("user"))
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    g = s.groupBy("trip_id").agg(us(F.min("starttimestamp")).alias("a"), us(F.max(F.coalesce("endtimestamp", "starttimestamp"))).alias("b"))
    return g.join(who, "trip_id").select("user", "trip_id", "a", "b")


SQL_MODE = "CASE regexp_replace(lower(label), '[^a-z]', '', 'g') " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in MODES.items()) + " END"
SQL_TRACKS = (
    "tr AS (SELECT user_id || '/' || strftime(received_at, '%Y-%m-%d') AS track, event_id AS id, epoch_us(received_at) AS t, point.latitude AS lat, point.longitude AS lon "
    "FROM locationeventpertime WHERE received_at IS NOT NULL AND user_id IS NOT NULL AND point.latitude BETWEEN -90 AND 90 AND point.longitude BETWEEN -180 AND 180 "
    "AND NOT (point.latitude = 0 AND point.longitude = 0) AND accuracy > 0 AND accuracy <= 200)"
)
SQL_MODES = (
    f"mo AS (SELECT * FROM (SELECT citizen_id || '/' || strftime(starttimestamp, '%Y-%m-%d') AS track, stage_id AS id, epoch_us(starttimestamp) AS t, {SQL_MODE} AS mode, coalesce(prob, 0.0::double) AS prob "
    "FROM predictedstage JOIN trip USING (trip_id) WHERE starttimestamp IS NOT NULL AND citizen_id IS NOT NULL) WHERE mode IS NOT NULL QUALIFY row_number() OVER (PARTITION BY track, t ORDER BY id) = 1)"
)
_BESIDE = f"abs(sqrt(x::double * x + y::double * y + z::double * z) - {GRAVITY}::double)"
SQL_SENSOR = (
    "se AS (SELECT user_id, user_id || '/' || strftime(make_timestamp(t), '%Y-%m-%d') AS track, id, t, x, y, z, CASE "
    + " ".join(f"WHEN {_BESIDE} < {m} THEN '{k}'" for k, m in SHAKES.items())
    + " ELSE 'bike' END AS label FROM (SELECT user_id, event_id AS id, epoch_us(try_strptime(trim(timestamp), '%Y%m%d%H%M%S%g')) AS t, x::double AS x, y::double AS y, z::double AS z FROM accelerometerevent "
    "WHERE abs(x) <= 160 AND abs(y) <= 160 AND abs(z) <= 160 AND user_id IS NOT NULL AND length(trim(timestamp)) = 17) WHERE t IS NOT NULL)"
)
SQL_SPANS = (
    "sp AS (SELECT citizen_id AS u, trip_id, a, b FROM (SELECT trip_id, epoch_us(min(starttimestamp)) AS a, epoch_us(max(coalesce(endtimestamp, starttimestamp))) AS b "
    "FROM predictedstage WHERE starttimestamp IS NOT NULL GROUP BY 1) JOIN trip USING (trip_id) WHERE citizen_id IS NOT NULL)"
)


def sql_km(a: str, b: str, c: str, d: str) -> str:
    """SQL of the great-circle distance in km."""
    return f"(12742.0::double * asin(sqrt(least(1.0::double, power(sin(radians({c} - {a}) / 2), 2) + power(sin(radians({d} - {b}) / 2), 2) * cos(radians({a})) * cos(radians({c}))))))"


def sql_kmh(km: str, s: str) -> str:
    return f"(CASE WHEN {s} = 0 THEN 0.0::double ELSE {km} * 1000.0::double / nullif({s}, 0) * 3.6::double END)"


def sql_bearing(a: str, b: str, c: str, d: str) -> str:
    return f"(((degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))) + 360.0::double) % 360.0::double + 360.0::double) % 360.0::double)"


SQL_W = "WINDOW w AS (PARTITION BY track ORDER BY t, id)"
SQL_PAIRS = (
    SQL_TRACKS
    + ", nx AS (SELECT *, lead(t) OVER w AS t2, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM tr "
    + SQL_W
    + "), pr AS (SELECT *, floor((t2 - t) / 1000000.0::double)::bigint AS s, "
    + sql_km("lat", "lon", "lat2", "lon2")
    + " AS km FROM nx WHERE t2 IS NOT NULL)"
)
