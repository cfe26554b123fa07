"""Queries on trajectories: geodesy, outliers, windows, segments, trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import geo
from wayfare.operators import clusters, trajectory, trips
from wayfare.plans.registry import query
from wayfare.settings import STUDY
from wayfare.sources.tables import table
from wayfare.sources.tracks import (
    SQL_PAIRS, SQL_TRACKS, SQL_W, day_tracks, sql_bearing, sql_km, sql_kmh,
)

R = lambda c, n=6: F.round(c, n)
GAP_S, TRIP, STOP = STUDY.gap_s, STUDY.window, STUDY.stop


@query(f"WITH {SQL_PAIRS} SELECT id, round(km, 6) AS km, round({sql_kmh('km', 's')}, 6) AS kmh, s AS seconds FROM pr")
def haversine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    p = trajectory.pairs(day_tracks(spark, folder))
    return p.select("id", R("km").alias("km"), R(geo.speed_kmh("km", "s")).alias("kmh"), F.col("s").alias("seconds"))


@query(f"WITH {SQL_PAIRS} SELECT id, round({sql_bearing('lat', 'lon', 'lat2', 'lon2')}, 6) AS bearing FROM pr")
def bearings(spark: SparkSession, folder: str) -> DataFrame:
    return trajectory.pairs(day_tracks(spark, folder)).select("id", R(geo.bearing_deg("lat", "lon", "lat2", "lon2")).alias("bearing"))


@query(
    f"""WITH {SQL_PAIRS}, a AS (SELECT *, radians(lat) AS p, radians({sql_bearing('lat', 'lon', 'lat2', 'lon2')}) AS b, km / 2 / 6378.1::double AS r FROM pr),
z AS (SELECT *, asin(sin(p) * cos(r) + cos(p) * sin(r) * cos(b)) AS p2 FROM a)
SELECT id, round(degrees(p2), 6) AS lat_mid, round(degrees(radians(lon) + atan2(sin(b) * sin(r) * cos(p), cos(r) - sin(p) * sin(p2))), 6) AS lon_mid FROM z"""
)
def destination_points(spark: SparkSession, folder: str) -> DataFrame:
    p = trajectory.pairs(day_tracks(spark, folder))
    lat, lon = geo.destination(F.col("lat"), F.col("lon"), geo.bearing_deg("lat", "lon", "lat2", "lon2"), F.col("km") / 2)
    return p.select("id", R(lat).alias("lat_mid"), R(lon).alias("lon_mid"))


@query(
    f"""WITH {SQL_PAIRS}, v AS (SELECT *, {sql_kmh('km', 's')} AS v1 FROM pr), w AS (SELECT *, lead(v1) OVER w AS v2 FROM v {SQL_W})
SELECT id, round(CASE WHEN v1 = 0 THEN 0.0::double ELSE (v2 - v1) / nullif(v1, 0) END, 6) AS rate FROM w WHERE v2 IS NOT NULL"""
)
def velocity_change(spark: SparkSession, folder: str) -> DataFrame:
    p = trajectory.pairs(day_tracks(spark, folder)).withColumn("v1", geo.speed_kmh("km", "s"))
    p = p.withColumn("v2", F.lead("v1").over(trajectory.along())).where("v2 is not null")
    return p.select("id", R(geo.velocity_change_rate("v1", "v2")).alias("rate"))


@query(f"WITH {SQL_PAIRS} SELECT track, round(sum(km), 6) AS km FROM pr GROUP BY track")
def path_length(spark: SparkSession, folder: str) -> DataFrame:
    return trajectory.pairs(day_tracks(spark, folder)).groupBy("track").agg(R(F.sum("km")).alias("km"))


@query(f"WITH {SQL_PAIRS}, v AS (SELECT track, CASE WHEN min(s) > 0 THEN round(avg(km * 1000.0::double / nullif(s, 0) * 3.6::double), 6) END AS kmh FROM pr GROUP BY track) SELECT DISTINCT tr.track, kmh FROM tr LEFT JOIN v ON v.track = tr.track")
def trip_avg_speed(spark: SparkSession, folder: str) -> DataFrame:
    v = trajectory.mean_pair_speed(day_tracks(spark, folder), ["track"])
    return v.select("track", R("kmh").alias("kmh"))


_OUT = f"""{SQL_TRACKS}, n3 AS (SELECT *, lag(t) OVER w AS ta, lag(lat) OVER w AS la, lag(lon) OVER w AS oa, lead(t) OVER w AS tc, lead(lat) OVER w AS lc, lead(lon) OVER w AS oc FROM tr {SQL_W}),
q AS (SELECT *, {sql_km('la', 'oa', 'lat', 'lon')} AS d12, {sql_km('lat', 'lon', 'lc', 'oc')} AS d23, {sql_km('la', 'oa', 'lc', 'oc')} AS d13,
  floor((t - ta) / 1000000.0::double)::bigint AS s12, floor((tc - t) / 1000000.0::double)::bigint AS s23, floor((tc - ta) / 1000000.0::double)::bigint AS s13,
  abs(abs({sql_bearing('la', 'oa', 'lat', 'lon')} - {sql_bearing('lat', 'lon', 'lc', 'oc')}) - 180) AS turn FROM n3 WHERE ta IS NOT NULL AND tc IS NOT NULL),
outl AS (SELECT * FROM q WHERE (turn <= 5 AND s13 <= 90 AND d12 >= 0.1) OR (d13 <= 0.1 AND {sql_kmh('d12', 's12')} >= 30 AND {sql_kmh('d23', 's23')} >= 30))"""


@query(f"WITH {_OUT} SELECT id, track FROM outl")
def gps_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return trajectory.outliers(day_tracks(spark, folder)).select("id", "track")


@query(f"WITH {_OUT} SELECT track, count(*)::bigint AS n FROM tr WHERE id NOT IN (SELECT id FROM outl) GROUP BY track")
def outliers_removed(spark: SparkSession, folder: str) -> DataFrame:
    d = day_tracks(spark, folder)
    kept = trajectory.without(d, trajectory.outliers(d))
    return kept.groupBy("track").agg(F.count(F.lit(1)).alias("n"))


@query("WITH d AS (SELECT user_id, timestamp, point.latitude AS lat, point.longitude AS lon FROM locationeventpertime) SELECT user_id, count(*)::bigint AS n, count(DISTINCT (timestamp, lat, lon))::bigint AS distinct_n FROM d WHERE timestamp IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL GROUP BY user_id")
def distinct_points(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "locationeventpertime").select("user_id", "timestamp", "point.latitude", "point.longitude").dropna()
    g = d.groupBy("user_id", "timestamp", "latitude", "longitude").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("user_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct_n"))


@query(f"WITH {SQL_TRACKS}, c AS (SELECT *, round(lat, 3) AS a, round(lon, 3) AS b FROM tr), l AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM c {SQL_W}) SELECT id FROM l WHERE pa IS NULL OR pa <> a OR pb <> b")
def dedup_consecutive(spark: SparkSession, folder: str) -> DataFrame:
    d = day_tracks(spark, folder).withColumns({"lat": F.round("lat", 3), "lon": F.round("lon", 3)})
    return trajectory.dedup_consecutive(d).select("id")


@query(f"WITH {SQL_TRACKS}, n AS (SELECT *, lead(t) OVER w AS t2, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM tr {SQL_W}) SELECT id FROM n WHERE t2 IS NULL OR ({sql_km('lat', 'lon', 'lat2', 'lon2')} * 1000 >= 800 AND floor((t2 - t) / 1000000.0::double) >= 120)")
def tidy_resample(spark: SparkSession, folder: str) -> DataFrame:
    return trajectory.tidy(day_tracks(spark, folder), 800.0, 120).select("id")


_SEG = f"""{SQL_TRACKS}, g0 AS (SELECT *, CASE WHEN t - lag(t) OVER w > {GAP_S}000000 THEN 1 ELSE 0 END AS cut FROM tr {SQL_W}),
sg AS (SELECT *, (sum(cut) OVER w)::bigint AS segment FROM g0 {SQL_W})"""


@query(
    f"""WITH {_SEG}, h AS (SELECT *, lag(lat) OVER v AS pa, lag(lon) OVER v AS po FROM sg WINDOW v AS (PARTITION BY track, segment ORDER BY t, id)),
a AS (SELECT track, segment, count(*)::bigint AS n, min(t) AS start_t, max(t) AS end_t, coalesce(sum({sql_km('pa', 'po', 'lat', 'lon')}), 0.0) AS km FROM h GROUP BY 1, 2)
SELECT track, segment, n, start_t, end_t, round(km, 6) AS km, round({sql_kmh('km', 'floor((end_t - start_t) / 1000000.0::double)')}, 6) AS kmh FROM a"""
)
def trip_summary(spark: SparkSession, folder: str) -> DataFrame:
    s = trajectory.path_stats(trajectory.gap_segments(day_tracks(spark, folder), GAP_S), ["track", "segment"])
    return s.select("track", "segment", "n", "start_t", "end_t", R("km").alias("km"), R("kmh").alias("kmh"))


@query(f"WITH {_SEG} SELECT id, segment FROM sg")
def gap_segments(spark: SparkSession, folder: str) -> DataFrame:
    return trajectory.gap_segments(day_tracks(spark, folder), GAP_S).select("id", "segment")


@query("WITH d AS (SELECT date_trunc('day', received_at)::date AS day, count(*) AS n FROM locationeventpertime WHERE received_at IS NOT NULL GROUP BY 1), b AS (SELECT min(day) AS a, max(day) AS z FROM d) SELECT r.day::date::varchar AS day, coalesce(d.n, 0)::bigint AS n FROM (SELECT unnest(generate_series(a::timestamp, z::timestamp, INTERVAL 1 DAY)) AS day FROM b) r LEFT JOIN d ON d.day = r.day::date")
def day_split(spark: SparkSession, folder: str) -> DataFrame:
    """Fixes per UTC day, days without any included."""
    d = table(spark, folder, "locationeventpertime").where("received_at is not null").select(F.unix_micros(F.col("received_at").cast("timestamp")).alias("t"))
    n = trajectory.calendar_counts(d, "t", 1, "day", empty=True)
    return n.select(F.date_format(F.timestamp_micros("start_t"), "yyyy-MM-dd").alias("day"), "n")


@query("SELECT epoch_us(time_bucket(INTERVAL 15 MINUTE, received_at)) AS start_t, count(*)::bigint AS n FROM locationeventpertime WHERE received_at IS NOT NULL GROUP BY 1")
def calendar_split(spark: SparkSession, folder: str) -> DataFrame:
    """Fixes per quarter of an hour."""
    d = table(spark, folder, "locationeventpertime").where("received_at is not null").select(F.unix_micros(F.col("received_at").cast("timestamp")).alias("t"))
    return trajectory.calendar_counts(d, "t", 15, "minute")


@query(
    f"""WITH {SQL_TRACKS}, w0 AS (SELECT *, t - t % 3600000000 AS win FROM tr), h AS (SELECT *, lag(lat) OVER v AS pa, lag(lon) OVER v AS po FROM w0 WINDOW v AS (PARTITION BY track, win ORDER BY t, id)),
g AS (SELECT track, win, count(*)::bigint AS n, arg_min(id, (t, id)) AS first_id, arg_max(id, (t, id)) AS last_id, arg_min(lat, (t, id)) AS la, arg_min(lon, (t, id)) AS oa, arg_max(lat, (t, id)) AS lb, arg_max(lon, (t, id)) AS ob,
  coalesce(sum({sql_km('pa', 'po', 'lat', 'lon')}), 0.0) AS path_km, floor((max(t) - min(t)) / 1000000.0::double) AS s FROM h GROUP BY 1, 2)
SELECT track, win, n, first_id, last_id, round(sqrt((lb - la) * (lb - la) + (ob - oa) * (ob - oa)), 6) AS degrees, round({sql_km('la', 'oa', 'lb', 'ob')}, 6) AS km, round(path_km, 6) AS path_km, round({sql_kmh('path_km', 's')}, 6) AS kmh FROM g"""
)
def tumbling_window_stats(spark: SparkSession, folder: str) -> DataFrame:
    s = trajectory.tumbling_stats(day_tracks(spark, folder), 3600)
    return s.select("track", "win", "n", "first_id", "last_id", R("degrees").alias("degrees"), R("km").alias("km"), R("path_km").alias("path_km"), R("kmh").alias("kmh"))


_WIN = f"""{SQL_TRACKS}, s0 AS (SELECT *, t % 86400000000 AS sod FROM tr),
wk AS (SELECT k::bigint AS k FROM (SELECT unnest(range(0, 86400 - {TRIP['window_s']}, {TRIP['step_s']})) AS k)),
wp AS (SELECT s0.*, wk.k FROM s0 JOIN wk ON sod >= wk.k * 1000000 AND sod <= (wk.k + {min(TRIP['window_s'], TRIP['step_s'])}) * 1000000),
wg AS (SELECT track, k, arg_min(id, (t, id)) AS first_id, arg_max(id, (t, id)) AS last_id, arg_min(lat, (t, id)) AS la, arg_min(lon, (t, id)) AS oa, arg_max(lat, (t, id)) AS lb, arg_max(lon, (t, id)) AS ob FROM wp GROUP BY 1, 2)"""


@query(f"WITH {_WIN} SELECT track, k, first_id, last_id, {sql_km('la', 'oa', 'lb', 'ob')} >= {TRIP['threshold_km']} AS moving FROM wg")
def window_distance_categories(spark: SparkSession, folder: str) -> DataFrame:
    return trajectory.day_windows(day_tracks(spark, folder), **TRIP)


@query(
    f"""WITH RECURSIVE {_WIN}, fc AS (SELECT track, first_id AS id, arg_min({sql_km('la', 'oa', 'lb', 'ob')} >= {TRIP['threshold_km']}, k) AS moving FROM wg GROUP BY 1, 2),
pt AS (SELECT tr.track, tr.id, CASE WHEN moving THEN 1 WHEN NOT moving THEN 0 ELSE -1 END AS cat, row_number() OVER (PARTITION BY tr.track ORDER BY tr.t, tr.id) AS i FROM tr LEFT JOIN fc ON fc.track = tr.track AND fc.id = tr.id),
st AS (SELECT track, 0::bigint AS i, false AS live, 0 AS noise, NULL::bigint AS a, NULL::bigint AS b, 0::bigint AS n, NULL::bigint AS da, NULL::bigint AS db, 0::bigint AS dn FROM (SELECT DISTINCT track FROM pt)
  UNION ALL SELECT track, i, y.live, y.noise, y.a, y.b, y.n, y.da, y.db, y.dn FROM (SELECT s.track, p.i, CASE
      WHEN s.live AND p.cat = 0 AND s.noise > {STUDY.noise} THEN {{'live': false, 'noise': 0, 'a': NULL::bigint, 'b': NULL::bigint, 'n': 0::bigint, 'da': s.a, 'db': s.b, 'dn': s.n}}
      WHEN s.live THEN {{'live': true, 'noise': s.noise + (p.cat = 0)::int, 'a': s.a, 'b': p.id, 'n': s.n + 1, 'da': NULL::bigint, 'db': NULL::bigint, 'dn': 0::bigint}}
      WHEN p.cat = 1 THEN {{'live': true, 'noise': 0, 'a': p.id, 'b': p.id, 'n': 1::bigint, 'da': NULL::bigint, 'db': NULL::bigint, 'dn': 0::bigint}}
      ELSE {{'live': false, 'noise': 0, 'a': NULL::bigint, 'b': NULL::bigint, 'n': 0::bigint, 'da': NULL::bigint, 'db': NULL::bigint, 'dn': 0::bigint}} END AS y
    FROM st s JOIN pt p ON p.track = s.track AND p.i = s.i + 1))
SELECT track, row_number() OVER (PARTITION BY track ORDER BY i) - 1 AS trip, da AS start_id, db AS end_id, dn AS n FROM st WHERE dn > {STUDY.least_points}"""
)
def window_distance_trips(spark: SparkSession, folder: str) -> DataFrame:
    t = trajectory.window_trips(day_tracks(spark, folder), **TRIP, noise=STUDY.noise, least=STUDY.least_points)
    return t


@query(
    f"""WITH {_SEG}, a AS (SELECT track, segment, min(t) AS start_t, max(t) AS end_t FROM sg GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN start_t - max(end_t) OVER (PARTITION BY track ORDER BY start_t, end_t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM a),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY track ORDER BY start_t, end_t) AS chain FROM b)
SELECT track, min(start_t) AS start_t, max(end_t) AS end_t, count(*)::bigint AS n FROM c GROUP BY track, chain"""
)
def trip_merge(spark: SparkSession, folder: str) -> DataFrame:
    s = trajectory.gap_segments(day_tracks(spark, folder), GAP_S).groupBy("track", "segment").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"))
    m = trajectory.merge_intervals_within(s, "track", "start_t", "end_t", 1_800_000_000)
    return m.select("track", "start_t", "end_t", "n")


@query()
def tdbscan_stops(spark: SparkSession, folder: str) -> DataFrame:
    s = clusters.stop_points(day_tracks(spark, folder), **STOP)
    g = s.groupBy("track", "stop").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("start_t"), F.max("t").alias("end_t"), R(F.avg("lat")).alias("lat"), R(F.avg("lon")).alias("lon"))
    return g


@query()
def tdbscan_expanding_stops(spark: SparkSession, folder: str) -> DataFrame:
    s = clusters.stop_points(day_tracks(spark, folder), **STOP, expand_all=True)
    return s.groupBy("track", "stop").agg(F.count(F.lit(1)).alias("n"))


@query()
def cluster_trips(spark: SparkSession, folder: str) -> DataFrame:
    d = day_tracks(spark, folder)
    t = clusters.trips_between_stops(d, trips.find_stops(d), STUDY.least_kmh)
    return t.withColumn("kmh", R("kmh"))


@query()
def extract_trips(spark: SparkSession, folder: str) -> DataFrame:
    """Trips of all tracks: outliers out, gaps split, by stops or by windows, joined where less than five minutes apart."""
    e = trips.trip_ends(trips.extract_trips(day_tracks(spark, folder)))
    return e.select("track", "trip", "how", "n", "start_id", "end_id", "start_t", "end_t")


@query()
def extract_trips_whole(spark: SparkSession, folder: str) -> DataFrame:
    """The variant that looks for stops in the whole track first, without a gap split."""
    e = trips.trip_ends(trips.merged_by_track(day_tracks(spark, folder)))
    return e.select("track", "trip", "how", "n", "start_id", "end_id", "start_t", "end_t")


_EDGES = """{tracks}, ed AS (SELECT a.track, a.id, b.id AS id2 FROM tr a JOIN tr b ON a.track = b.track AND abs(a.lat - b.lat) < {deg} AND {km} <= {eps}{time}),
co AS (SELECT track, id FROM ed GROUP BY 1, 2 HAVING count(*) >= {least}),
ce AS (SELECT ed.* FROM ed JOIN co x ON x.track = ed.track AND x.id = ed.id JOIN co y ON y.track = ed.track AND y.id = ed.id2),
low AS (SELECT track, id FROM ce GROUP BY 1, 2 HAVING min(id2) = id),
re AS (SELECT track, id, id AS root FROM low UNION SELECT ce.track, ce.id2, re.root FROM re JOIN ce ON ce.track = re.track AND ce.id = re.id),
la AS (SELECT track, id, min(root) AS cluster FROM re GROUP BY 1, 2),
bo AS (SELECT ed.track, ed.id, min(la.cluster) AS border FROM ed JOIN la ON la.track = ed.track AND la.id = ed.id2 GROUP BY 1, 2)
SELECT tr.id, coalesce(cluster, border) AS cluster FROM tr LEFT JOIN la ON la.track = tr.track AND la.id = tr.id LEFT JOIN bo ON bo.track = tr.track AND bo.id = tr.id"""


def _sql_dbscan(eps: float, least: int, within_s: int | None = None) -> str:
    time = "" if within_s is None else f" AND abs(a.t - b.t) <= {within_s}000000"
    return "WITH RECURSIVE " + _EDGES.format(tracks=SQL_TRACKS, deg=eps / 100, km=sql_km("a.lat", "a.lon", "b.lat", "b.lon"), eps=eps, time=time, least=least)


@query(_sql_dbscan(0.05, 6))
def spatial_dbscan(spark: SparkSession, folder: str) -> DataFrame:
    c = clusters.density_clusters(day_tracks(spark, folder), 0.05, 6)
    return c.select("id", "cluster")


@query(_sql_dbscan(0.1, 4, 600))
def st_dbscan(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.density_clusters(day_tracks(spark, folder), 0.1, 4, within_s=600).select("id", "cluster")
