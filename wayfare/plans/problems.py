"""Queries for the general data problems."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators.grid import regular_grid
from wayfare.operators.intervals import periods_and_gaps
from wayfare.operators.mobility import stops_and_trips, usable_pings
from wayfare.operators.spikes import context_flags, hourly_fences, implausible_speeds, implausible_vectors
from wayfare.operators.zones import estimate_zones, instants_beside, normalise_instants
from wayfare.functions.timestamps import read_instants
from wayfare.plans.sqltext import SQL_LOCATIONS, SQL_SHAKES, SQL_TRIPS
from wayfare.sources.tracks import sql_km
from wayfare.sources.tables import accelerations, locations, table, trips, with_zone

HOUR_US = 3_600_000_000


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    rows = locations(spark, folder)
    point = usable_pings(rows, "user_id", "instant_us", "event_id", "accuracy", F.col("point.latitude"), F.col("point.longitude"))
    return stops_and_trips(point)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _segments(spark, folder).select(F.col("device").alias("user_id"), "kind", "first_id", "last_id")


def p2_mobility(spark: SparkSession, folder: str) -> DataFrame:
    return _segments(spark, folder).withColumnRenamed("device", "user_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pings = with_zone(spark, folder, table(spark, folder, "locationeventpertime"), "user_id", "zone")
    pings = normalise_instants(pings, "user_id", "timestamp", "zone", "epoch_us", day="day", ingested="received_at")
    moves = with_zone(spark, folder, table(spark, folder, "trip"), "citizen_id", "zone")
    moves = normalise_instants(moves, "citizen_id", "start_timestamp", "zone", "epoch_us", ingested="stop_timestamp")
    one = pings.select(F.lit("locationeventpertime").alias("source_table"), F.col("event_id").alias("row_id"), "epoch_us")
    two = moves.select(F.lit("trip").alias("source_table"), F.col("trip_id").alias("row_id"), "epoch_us")
    return one.unionByName(two).where("epoch_us is not null")


def p3_zones(spark: SparkSession, folder: str) -> DataFrame:
    """The zone of every user as estimated from ingestion times alone, the stated one unused."""
    pings = table(spark, folder, "locationeventpertime").withColumn("none", F.lit(None).cast("string"))
    walls = read_instants(pings, "timestamp", "known_us", "none", day="day", wall="wall_us")
    walls = walls.withColumn("ingested_us", F.unix_micros(F.col("received_at").cast("timestamp")))
    return estimate_zones(walls, "user_id", "wall_us", "ingested_us")


def p3_zones_by_order(spark: SparkSession, folder: str) -> DataFrame:
    """The same by sequence order alone: a text without zone stands near the instants of the texts with one that arrived
    before it, of the same UTC day of arrival; how long any took to arrive is not used."""
    pings = table(spark, folder, "locationeventpertime").withColumn("none", F.lit(None).cast("string"))
    walls = read_instants(pings, "timestamp", "known_us", "none", day="day", wall="wall_us")
    walls = walls.select("user_id", F.unix_micros(F.col("received_at").cast("timestamp")).alias("arrived"), "known_us", "wall_us")
    near = instants_beside(walls, "user_id", "arrived", "known_us", "near_us", stretch=24 * HOUR_US)
    return estimate_zones(near, "user_id", "wall_us", "near_us", early_us=25 * 60_000_000, late_us=25 * 60_000_000)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    shaken = lambda: implausible_vectors(accelerations(spark, folder), "user_id", "instant_us", "event_id", ["x", "y", "z"])
    fast = lambda: implausible_speeds(table(spark, folder, "locationeventpertime"), "user_id", "instant_us", "event_id", "speed", timed=locations(spark, folder))
    # The two tables have nothing to do with each other: their statistics are gathered side by side.
    with ThreadPoolExecutor(2) as pool:
        shaken, fast = (f.result() for f in [pool.submit(inheritable_thread_target(spark)(f)) for f in (shaken, fast)])
    return shaken.select(F.lit("accelerometerevent").alias("source_table"), "event_id").unionByName(
        fast.select(F.lit("locationeventpertime").alias("source_table"), "event_id")
    )


def p5_fences(spark: SparkSession, folder: str) -> DataFrame:
    """The interquartile fences of every user, hour of day and axis of the accelerations, and of the speeds."""
    a, p = accelerations(spark, folder), locations(spark, folder)
    parts = [hourly_fences(a, "user_id", "instant_us", c).withColumn("axis", F.lit(c)) for c in "xyz"]
    parts.append(hourly_fences(p, "user_id", "instant_us", "speed").withColumn("axis", F.lit("speed")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def p5_context(spark: SparkSession, folder: str) -> DataFrame:
    """(source_table, event_id, axis, reason): readings beyond their user's fences at their hour of day, that change too
    fast, or without variance."""
    shaken = context_flags(accelerations(spark, folder), "user_id", "instant_us", "event_id", ["x", "y", "z"])
    moved = context_flags(locations(spark, folder), "user_id", "instant_us", "event_id", ["speed"])
    return shaken.select(F.lit("accelerometerevent").alias("source_table"), "*").unionByName(moved.select(F.lit("locationeventpertime").alias("source_table"), "*"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return periods_and_gaps(trips(spark, folder), "citizen_id", "start_us", "stop_us", most_gap_us=24 * HOUR_US)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    grid = regular_grid(accelerations(spark, folder), "user_id", "instant_us", "x")
    return grid.where("readings = 0").select("user_id", F.col("bucket").alias("epoch_minute"))


def p7_grid(spark: SparkSession, folder: str) -> DataFrame:
    return regular_grid(accelerations(spark, folder), "user_id", "instant_us", "x")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_mobility, p3_found, p3_zones, p3_zones_by_order, p5_found, p5_fences, p5_context, p6_found, p7_found, p7_grid)
}

_HELD = """SELECT {id} FROM (SELECT *, count(*) OVER (PARTITION BY {u}, run) AS len FROM (SELECT *, sum(fresh) OVER (PARTITION BY {u} ORDER BY instant_us, {id} ROWS UNBOUNDED PRECEDING) AS run FROM
  (SELECT *, ({same}) IS NOT TRUE AS fresh FROM (SELECT *, {lags} FROM {source} WINDOW w AS (PARTITION BY {u} ORDER BY instant_us, {id})))))
  WHERE len >= 8{more}"""


def _sql_held(source: str, values: str, more: str = "") -> str:
    lags = ", ".join(f"lag({v}) OVER w AS l_{v}" for v in values.split())
    return _HELD.format(id="event_id", u="user_id", source=source, lags=lags, same=" AND ".join(f"{v} = l_{v}" for v in values.split()), more=more)


_AXES = [f"SELECT event_id, user_id, {k} AS axis, {v}::double AS v FROM ac" for k, v in enumerate("xyz")]

_KMH = "{km} * 3600000000.0::double / ({b} - {a})"
_PINGS = f"""{SQL_LOCATIONS}, u AS (SELECT user_id, instant_us AS t, min(event_id) AS id, arg_min(point.latitude, event_id) AS lat, arg_min(point.longitude, event_id) AS lon FROM loc
  WHERE user_id IS NOT NULL AND instant_us IS NOT NULL AND accuracy > 0 AND accuracy <= 200 AND point.latitude BETWEEN -90 AND 90 AND point.longitude BETWEEN -180 AND 180 AND NOT (point.latitude = 0 AND point.longitude = 0) GROUP BY 1, 2),
n AS (SELECT *, lag(t) OVER w AS ta, lag(lat) OVER w AS la, lag(lon) OVER w AS oa, lead(t) OVER w AS tc, lead(lat) OVER w AS lc, lead(lon) OVER w AS oc FROM u WINDOW w AS (PARTITION BY user_id ORDER BY t)),
k AS (SELECT user_id, t, id, lat, lon FROM n WHERE NOT coalesce({_KMH.format(km=sql_km("la", "oa", "lat", "lon"), a="ta", b="t")} > 300 AND {_KMH.format(km=sql_km("lat", "lon", "lc", "oc"), a="t", b="tc")} > 300, false)),
f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 3600000000 THEN 0 ELSE 1 END AS fresh, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM k),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS ses FROM f),
x AS (SELECT a.user_id, a.i, min(b.i) AS mb FROM s a JOIN s b ON a.user_id = b.user_id AND a.ses = b.ses AND a.i < b.i AND {sql_km("a.lat", "a.lon", "b.lat", "b.lon")} * 1000 > 100 GROUP BY 1, 2),
e AS (SELECT s.*, coalesce(min(mb) OVER (PARTITION BY s.user_id, ses ORDER BY s.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 1, max(s.i) OVER (PARTITION BY s.user_id, ses)) AS e FROM s LEFT JOIN x ON x.user_id = s.user_id AND x.i = s.i),
g AS (SELECT e.user_id, e.ses, e.i, e.e, e.id, z.id AS ide FROM e JOIN s z ON z.user_id = e.user_id AND z.i = e.e WHERE z.t - e.t >= 600000000),
st AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY user_id, ses ORDER BY i) = 1
  UNION ALL SELECT g.* FROM st JOIN g ON g.user_id = st.user_id AND g.ses = st.ses AND g.i > st.e QUALIFY row_number() OVER (PARTITION BY g.user_id, g.ses ORDER BY g.i) = 1),
b AS (SELECT user_id, ses, min(i) AS lo, max(i) AS hi, arg_min(id, i) AS fid, arg_max(id, i) AS lid FROM s GROUP BY 1, 2),
v AS (SELECT user_id, ses, i, e, id, ide FROM st UNION ALL SELECT user_id, ses, lo - 1, lo - 1, fid, fid FROM b),
o AS (SELECT v.*, hi, lid, lead(i) OVER w AS ni, lead(id) OVER w AS nid FROM v JOIN b USING (user_id, ses) WINDOW w AS (PARTITION BY v.user_id, v.ses ORDER BY v.i))"""

ORACLES: dict[str, str] = {
    "p2_found": f"WITH RECURSIVE {_PINGS} SELECT user_id, 'stop' AS kind, id AS first_id, ide AS last_id FROM st UNION ALL SELECT user_id, 'trip', ide, coalesce(nid, lid) FROM o WHERE coalesce(ni, hi + 1) > e + 1",
    "p3_found": f"WITH {SQL_LOCATIONS}, {SQL_TRIPS} SELECT 'locationeventpertime' AS source_table, event_id AS row_id, instant_us AS epoch_us FROM loc WHERE instant_us IS NOT NULL UNION ALL SELECT 'trip', trip_id, start_us FROM mv WHERE start_us IS NOT NULL",
    "p5_found": f"""WITH {SQL_SHAKES}, {SQL_LOCATIONS},
ac AS (SELECT event_id, user_id, instant_us, CASE WHEN NOT isnan(x) THEN x END AS x, CASE WHEN NOT isnan(y) THEN y END AS y, CASE WHEN NOT isnan(z) THEN z END AS z FROM acc),
v AS ({" UNION ALL ".join(_AXES)}), med AS (SELECT user_id, axis, median(v) AS m FROM v WHERE abs(v) <= 160 GROUP BY 1, 2),
mad AS (SELECT v.user_id, v.axis, any_value(m) AS m, median(abs(v - m)) AS d FROM v JOIN med ON med.user_id = v.user_id AND med.axis = v.axis WHERE abs(v) <= 160 GROUP BY 1, 2),
a_full AS (SELECT * FROM ac WHERE user_id IS NOT NULL AND instant_us IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
sp AS (SELECT event_id, user_id, instant_us, CASE WHEN NOT isnan(speed) THEN speed END AS speed FROM loc),
lim AS (SELECT user_id, quantile_cont(speed::double, 0.9) * 3 AS most FROM sp WHERE speed > 0 AND speed <= 100 GROUP BY 1),
s_full AS (SELECT * FROM sp WHERE user_id IS NOT NULL AND instant_us IS NOT NULL AND speed IS NOT NULL)
SELECT DISTINCT 'accelerometerevent' AS source_table, event_id FROM (
  SELECT event_id FROM v WHERE abs(v) > 160 UNION ALL SELECT v.event_id FROM v JOIN mad ON mad.user_id = v.user_id AND mad.axis = v.axis WHERE abs(v - m) > 12 * d UNION ALL {_sql_held("a_full", "x y z")})
UNION ALL SELECT DISTINCT 'locationeventpertime', event_id FROM (
  SELECT event_id FROM sp WHERE speed < 0 OR speed > 100 UNION ALL SELECT event_id FROM sp JOIN lim USING (user_id) WHERE speed::double > most UNION ALL {_sql_held("s_full", "speed", " AND speed <> 0")})""",
    "p6_found": f"""WITH {SQL_TRIPS}, i AS (SELECT citizen_id, start_us AS a, epoch_us(stop_timestamp) AS b FROM mv WHERE citizen_id IS NOT NULL AND epoch_us(stop_timestamp) > start_us),
r AS (SELECT *, max(b) OVER (PARTITION BY citizen_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM i),
g AS (SELECT *, sum(CASE WHEN a <= so_far THEN 0 ELSE 1 END) OVER (PARTITION BY citizen_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS no FROM r),
p AS (SELECT citizen_id, no, min(a) AS from_us, max(b) AS to_us FROM g GROUP BY 1, 2), q AS (SELECT citizen_id, to_us AS from_us, lead(from_us) OVER (PARTITION BY citizen_id ORDER BY from_us) AS to_us FROM p)
SELECT citizen_id, 'period' AS kind, from_us, to_us FROM p UNION ALL SELECT citizen_id, 'gap', from_us, to_us FROM q WHERE to_us - from_us <= 86400000000""",
    "p7_grid": f"""WITH {SQL_SHAKES}, b AS (SELECT user_id, instant_us // 60000000 AS bucket, count(*) AS readings, avg(x::double) AS mean, min(instant_us) AS a, max(instant_us) AS z FROM acc
  WHERE user_id IS NOT NULL AND instant_us IS NOT NULL AND x IS NOT NULL AND NOT isnan(x) GROUP BY 1, 2),
n AS (SELECT *, CASE WHEN a - lag(z) OVER (PARTITION BY user_id ORDER BY bucket) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM b),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS recording FROM n),
g AS (SELECT user_id, recording, unnest(range(min(bucket), max(bucket) + 1)) AS bucket FROM k GROUP BY 1, 2),
j AS (SELECT g.user_id, g.recording, g.bucket, readings, mean FROM g LEFT JOIN k ON k.user_id = g.user_id AND k.bucket = g.bucket),
l AS (SELECT *, last_value(CASE WHEN readings IS NOT NULL THEN bucket END IGNORE NULLS) OVER w AS lb, last_value(mean IGNORE NULLS) OVER w AS lm FROM j WINDOW w AS (PARTITION BY user_id, recording ORDER BY bucket ROWS UNBOUNDED PRECEDING))
SELECT user_id, recording::bigint AS recording, bucket, coalesce(readings, 0)::bigint AS readings, CASE WHEN readings IS NOT NULL THEN mean WHEN (bucket - lb) * 60000000 <= 300000000 THEN lm END AS value, (readings IS NULL AND (bucket - lb) * 60000000 <= 300000000) AS filled FROM l""",
    "p7_found": """
WITH r AS (SELECT user_id, epoch_us(strptime(trim(timestamp), '%Y%m%d%H%M%S%g')) AS t FROM accelerometerevent
           WHERE user_id IS NOT NULL AND length(trim(timestamp)) = 17 AND x IS NOT NULL AND NOT isnan(x)),
g AS (SELECT user_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS p FROM r)
SELECT user_id, unnest(range(p // 60000000 + 1, t // 60000000)) AS epoch_minute FROM g
WHERE t - p <= 1800000000 AND t // 60000000 > p // 60000000 + 1""",
}
