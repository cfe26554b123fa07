"""Queries on days, stored rows, documents, and the whole way from raw records to stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare import pipeline
from wayfare.functions import encodings, geo
from wayfare.operators import clusters, modes, provenance, scoring, stages, trajectory, trips
from wayfare.plans.registry import query
from wayfare.plans.sequences import LABELS, SQL_STAGES, _ends, _points
from wayfare.plans.sqltext import SQL_LOCATIONS, SQL_TRIPS
from wayfare.session import cut
from wayfare.settings import STUDY
from wayfare.sources import rows, scans
from wayfare.sources.places import SQL_PLACES, address_of, nearby, places
from wayfare.sources.tables import locations, table
from wayfare.sources.tables import trips as read_trips
from wayfare.sources.tracks import SQL_MODES, SQL_TRACKS, SQL_W, day_tracks, mode_sequence, sql_km, sql_kmh

R = lambda c, n=6: F.round(c, n)


def _busiest_day(spark: SparkSession, folder: str, name: str) -> str | None:
    n = table(spark, folder, name).where("day is not null").groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.max_by("day", F.struct("n", "day"))).first()[0]


@query("SELECT DISTINCT l.event_id, user_id, accuracy FROM locationeventpertime l JOIN citizen ON citizen_id = user_id WHERE day = (SELECT arg_max(day, (n, day)) FROM (SELECT day, count(*) AS n FROM locationeventpertime WHERE day IS NOT NULL GROUP BY 1)) AND accuracy < 100 AND coalesce(collection_mode, 'CONTINUOUS') = 'CONTINUOUS'")
def scan_day(spark: SparkSession, folder: str) -> DataFrame:
    """The fixes of the day with most, of the users of one collection mode, with a good accuracy: all three reach the scan or a semi join."""
    users = scans.allowed_users(spark, folder, "CONTINUOUS")
    return scans.scan_positions(spark, folder, _busiest_day(spark, folder, "locationeventpertime"), users, 100.0).select("event_id", "user_id", "accuracy")


@query("SELECT event_id, user_id, x::double AS x, y::double AS y, z::double AS z FROM accelerometerevent WHERE day = (SELECT arg_max(day, (n, day)) FROM (SELECT day, count(*) AS n FROM accelerometerevent WHERE day IS NOT NULL GROUP BY 1))")
def scan_acc_day(spark: SparkSession, folder: str) -> DataFrame:
    return scans.scan_accelerations(spark, folder, _busiest_day(spark, folder, "accelerometerevent")).select("event_id", "user_id", "x", "y", "z")


@query(f"WITH {SQL_LOCATIONS} SELECT DISTINCT user_id, instant_us, point.latitude AS lat, point.longitude AS lon FROM loc WHERE instant_us IS NOT NULL AND point.latitude IS NOT NULL AND point.longitude IS NOT NULL")
def sorted_points(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct positions of each user in order of the instants written."""
    x = locations(spark, folder).select("user_id", "instant_us", F.col("point.latitude").alias("lat"), F.col("point.longitude").alias("lon")).dropna(subset=["instant_us", "lat", "lon"])
    return x.distinct().orderBy("user_id", "instant_us", "lat", "lon")


@query(f"WITH {SQL_TRIPS} SELECT DISTINCT strftime(make_timestamp(start_us), '%Y%m%d') AS day, citizen_id FROM mv WHERE start_us IS NOT NULL")
def users_started(spark: SparkSession, folder: str) -> DataFrame:
    """Who has trips that start on which UTC day."""
    t = read_trips(spark, folder).where("start_us is not null")
    return t.select(F.date_format(F.timestamp_micros("start_us"), "yyyyMMdd").alias("day"), "citizen_id").distinct()


_ARMS = f"""{SQL_TRACKS}, d AS (SELECT track, t, id, lat, lon FROM (SELECT *, lag((t, lat, lon)) OVER w AS was FROM tr {SQL_W}) WHERE was IS NULL OR was IS DISTINCT FROM (t, lat, lon))"""
_MARK = """'{{"type":"Feature","geometry":{{"type":"Point","coordinates":' || printf('[%.6f,%.6f]', {f}(lon, (t, id)), {f}(lat, (t, id))) || '}},"properties":{{"marker-symbol":"{s}"}}}}'"""
_LINE = """'{"type":"Feature","geometry":{"type":"LineString","coordinates":[' || string_agg(printf('[%.6f,%.6f]', lon, lat), ', ' ORDER BY t, id) || ']},"properties":' || printf('{"timestamp-start":%d,"timestamp-end":%d}', min(t), max(t)) || '}'"""


def _traces(spark: SparkSession, folder: str) -> DataFrame:
    g = day_tracks(spark, folder).groupBy("track").agg(F.sort_array(F.collect_list(F.struct("t", "id", "lat", "lon"))).alias("p"))
    return g.select("track", F.transform("p", lambda p: F.struct(p["t"].alias("t"), p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("trace"))


@query("WITH " + _ARMS + """ SELECT track, '{"type":"FeatureCollection","features":[' || """ + _MARK.format(f="arg_min", s="s") + " || ',' || " + _MARK.format(f="arg_max", s="e") + " || ',' || " + _LINE + " || ']}' AS geojson FROM d GROUP BY track")
def geojson_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Each track as its start, its end and its line, repeats left out."""
    return _traces(spark, folder).select("track", encodings.trip_document(F.col("trace")).alias("geojson"))


@query(f"WITH {SQL_STAGES} SELECT sf.track, stage, sf.mode, count(tr.id) + 2 AS points FROM sf LEFT JOIN tr ON tr.track = sf.track AND tr.t > start_t AND tr.t < end_t GROUP BY 1, 2, 3")
def stage_traces(spark: SparkSession, folder: str) -> DataFrame:
    """How many points the trace of each stage has: those strictly within it, and its two ends."""
    d = day_tracks(spark, folder)
    s = stages.stages(_points(spark, folder), _ends(d))
    return stages.stage_traces(s, d).select("track", "stage", "mode", F.size("trace").cast("long").alias("points"))


@query(f"WITH {SQL_TRACKS}, e AS (SELECT track, arg_min(lat, (t, id)) AS la, arg_min(lon, (t, id)) AS oa, arg_max(lat, (t, id)) AS lb, arg_max(lon, (t, id)) AS ob FROM tr GROUP BY 1) SELECT track, trunc((5.0::double * la * (7.0::double * oa) * (11.0::double * lb) * (17.0::double * ob)) % 2147483647)::int AS key FROM e")
def trip_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The number that each track is stored under, by its two ends."""
    p = F.struct("t", "id", "lat", "lon")
    g = day_tracks(spark, folder).groupBy("track").agg(F.min(p).alias("a"), F.max(p).alias("b"))
    return g.select("track", trips.trip_key(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")).alias("key"))


@query(f"WITH {SQL_TRACKS} SELECT id, TIMESTAMP '2018-06-03 00:00:00' + to_microseconds(t % 86400000000) AS clock FROM tr")
def clock_times(spark: SparkSession, folder: str) -> DataFrame:
    """The time of day of every fix, on one fixed day."""
    sod = F.pmod(F.col("t"), F.lit(86_400_000_000))
    return day_tracks(spark, folder).select("id", trajectory.clock_of(sod.cast("decimal(20,6)") / 1_000_000).alias("clock"))


@query(
    f"WITH {SQL_TRACKS}, n3 AS (SELECT id, t, lat, lon, lag(t) OVER w AS ta, lag(lat) OVER w AS la, lag(lon) OVER w AS oa, lead(t) OVER w AS tc, lead(lat) OVER w AS lc, lead(lon) OVER w AS oc FROM tr {SQL_W}), "
    f"v AS (SELECT id, {sql_kmh(sql_km('la', 'oa', 'lat', 'lon'), 'floor((t - ta) / 1000000.0::double)')} AS v1, {sql_kmh(sql_km('lat', 'lon', 'lc', 'oc'), 'floor((tc - t) / 1000000.0::double)')} AS v2 FROM n3 WHERE ta IS NOT NULL AND tc IS NOT NULL) "
    "SELECT id, round(CASE WHEN v1 = 0 THEN 0.0::double ELSE (v2 - v1) / nullif(v1, 0) END, 6) AS rate FROM v"
)
def velocity_change_triples(spark: SparkSession, folder: str) -> DataFrame:
    x = trajectory.triples(day_tracks(spark, folder))
    return x.select("id", R(geo.velocity_change_between(F.col("a"), F.col("b"), F.col("c"))).alias("rate"))


_RANKED = ", ".join(f"{{'p': embedding[{k + 1}]::double, 'k': {len(LABELS) - k}, 'm': '{m}'}}" for k, m in enumerate(LABELS))
_NAMES = "[" + ", ".join(f"'{m}'" for m in LABELS) + "]"


@query(f"SELECT round(avg(1.0::double / list_position(list_transform(list_reverse_sort([{_RANKED}]), lambda x: x.m), {_NAMES}[label % 6 + 1])), 9) AS mrr FROM embeddings")
def mean_reciprocal_rank(spark: SparkSession, folder: str) -> DataFrame:
    """How high the true label stands, on average, among labels ranked by their values."""
    ranked = F.array(*[F.struct(F.col("embedding")[k].cast("double").alias("p"), F.lit(len(LABELS) - k).alias("k"), F.lit(m).alias("m")) for k, m in enumerate(LABELS)])
    x = table(spark, folder, "embeddings").select(F.transform(F.sort_array(ranked, asc=False), lambda s: s["m"]).alias("ranked"), F.get(F.array(*map(F.lit, LABELS)), (F.col("label") % 6).cast("int")).alias("truth"))
    return modes.mean_reciprocal_rank(x, "ranked", "truth").select(R("mrr", 9).alias("mrr"))


@query(f"WITH {SQL_MODES} SELECT id, prob FROM mo")
def scores_by_position(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions that come back without a time, put beside their samples by position in the track."""
    m = mode_sequence(spark, folder)
    scores = trips.numbered(m, ["track"], ["t", "id"], "at").select("track", "at", "prob")
    return scoring.beside_by_position(m.drop("prob", "mode"), scores, ["track"], ["t", "id"], "at").select("id", "prob")


_GIVEN = f"""{SQL_TRACKS}, c AS (SELECT *, round(lat, 3) AS a, round(lon, 3) AS b FROM tr),
r AS (SELECT *, CASE WHEN (a, b) IS NOT DISTINCT FROM lag((a, b)) OVER w THEN 0 ELSE 1 END AS fresh FROM c {SQL_W}), g AS (SELECT *, sum(fresh) OVER w AS run FROM r {SQL_W}),
k AS (SELECT track, run, arg_min(id, (t, id)) AS ia, arg_max(id, (t, id)) AS ib, min(t) AS ta, max(t) AS tb FROM g GROUP BY 1, 2 HAVING count(*) >= 5),
l AS (SELECT track, row_number() OVER v - 1 AS trip, ib AS start_id, tb AS a, lead(ia) OVER v AS end_id, lead(ta) OVER v AS b FROM k WINDOW v AS (PARTITION BY track ORDER BY run)),
q AS (SELECT l.track, l.trip, tr.id, tr.t, tr.lat, tr.lon FROM l JOIN tr ON tr.track = l.track AND ((tr.t > l.a AND tr.t < l.b) OR tr.id = start_id OR tr.id = end_id) WHERE end_id IS NOT NULL
  UNION ALL SELECT tr.track, 0, tr.id, tr.t, tr.lat, tr.lon FROM tr WHERE track NOT IN (SELECT track FROM k)),
h AS (SELECT *, lag(t) OVER z AS pt, lag(lat) OVER z AS pa, lag(lon) OVER z AS po FROM q WINDOW z AS (PARTITION BY track, trip ORDER BY t, id)),
s AS (SELECT *, floor((t - pt) / 1000000.0::double) AS sec, {sql_km('pa', 'po', 'lat', 'lon')} * 1000.0::double AS m FROM h)
SELECT track, trip::bigint AS trip, arg_min(id, (t, id)) AS start_id, arg_max(id, (t, id)) AS end_id, count(*)::bigint AS n, round(avg(m / nullif(sec, 0) * 3.6::double), 6) AS kmh FROM s
GROUP BY 1, 2 HAVING count(*) FILTER (WHERE sec = 0) = 0 AND avg(m / nullif(sec, 0) * 3.6::double) > {STUDY.least_kmh}"""


@query("WITH " + _GIVEN)
def cluster_trips_given(spark: SparkSession, folder: str) -> DataFrame:
    """Trips between given stops: here, runs of five and more fixes with one rounded position."""
    w = trajectory.along()
    c = day_tracks(spark, folder)
    at = F.struct(R("lat", 3).alias("a"), R("lon", 3).alias("b"))
    g = c.withColumn("fresh", F.when(at.eqNullSafe(F.lag(at).over(w)), 0).otherwise(1)).withColumn("run", F.sum("fresh").over(w.rowsBetween(trajectory.Window.unboundedPreceding, 0)))
    g = g.withColumn("size", F.count(F.lit(1)).over(trajectory.Window.partitionBy("track", "run"))).where("size >= 5")
    runs = g.withColumns({"stop": F.dense_rank().over(trajectory.Window.partitionBy("track").orderBy("run")) - 1, "pos": F.row_number().over(trajectory.Window.partitionBy("track", "run").orderBy("t", "id"))})
    t = clusters.trips_between_stops(c, runs.select("track", F.col("stop").cast("long").alias("stop"), F.col("pos").cast("long").alias("pos"), "id", "t", "lat", "lon"), STUDY.least_kmh)
    return t.withColumn("kmh", R("kmh"))


_STORED = f"""{SQL_TRACKS}, {SQL_PLACES}, e AS (SELECT track, arg_min(lat, (t, id)) AS la, arg_min(lon, (t, id)) AS oa, min(t) AS ta, arg_max(lat, (t, id)) AS lb, arg_max(lon, (t, id)) AS ob, max(t) AS tb,
  '[' || string_agg(printf('[%.6f,%.6f]', lon, lat), ', ' ORDER BY t, id) || ']' AS path FROM tr GROUP BY 1),
na AS (SELECT track, arg_min(label, (k, poi_id)) AS label FROM (SELECT track, label, poi_id, {sql_km('la', 'oa', 'lat', 'lon')} AS k FROM e JOIN po ON abs(la - lat) < 0.01) WHERE k <= 0.2 GROUP BY 1),
nb AS (SELECT track, arg_min(label, (k, poi_id)) AS label FROM (SELECT track, label, poi_id, {sql_km('lb', 'ob', 'lat', 'lon')} AS k FROM e JOIN po ON abs(lb - lat) < 0.01) WHERE k <= 0.2 GROUP BY 1)
SELECT split_part(e.track, '/', 1) AS citizen_id, printf('[%.6f,%.6f]', la, oa) AS start_coordinate, strftime(make_timestamp(ta), '%Y-%m-%d %H:%M:%S.%g') AS start_timestamp, printf('[%.6f,%.6f]', lb, ob) AS stop_coordinate,
  strftime(make_timestamp(tb), '%Y-%m-%d %H:%M:%S.%g') AS stop_timestamp, coalesce(na.label, 'UNKNOWN_ADDRESS') AS start_address, coalesce(nb.label, 'UNKNOWN_ADDRESS') AS stop_address, path FROM e LEFT JOIN na ON na.track = e.track LEFT JOIN nb ON nb.track = e.track"""


def _addressed(spark: SparkSession, folder: str) -> DataFrame:
    x = cut(_traces(spark, folder).withColumn("user", F.substring_index("track", "/", 1)).withColumn("id", F.col("track")))
    pois = places(spark, folder)
    at = lambda p: x.select("id", p["lat"].alias("lat"), p["lon"].alias("lon"))
    a = address_of(at(F.get("trace", 0)), pois, 0.2).withColumnRenamed("address", "start_address")
    b = address_of(at(F.get(F.col("trace"), F.size("trace") - 1)), pois, 0.2).withColumnRenamed("address", "stop_address")
    return x.join(a, "id").join(b, "id")


@query("WITH " + _STORED)
def stored_trips(spark: SparkSession, folder: str) -> DataFrame:
    """Every track as the eight columns that a trip is stored with."""
    return rows.trip_rows(_addressed(spark, folder))


@query()
def questionnaires(spark: SparkSession, folder: str) -> DataFrame:
    """What each user is asked about each track: both ends with address, place and time."""
    x = _addressed(spark, folder)
    best = lambda p, name: nearby(x.select("id", p["lat"].alias("lat"), p["lon"].alias("lon")), places(spark, folder), 0.5, 1).select("id", F.col("label").alias(name))
    x = x.join(best(F.get("trace", 0), "start_poi"), "id", "left").join(best(F.get(F.col("trace"), F.size("trace") - 1), "stop_poi"), "id", "left")
    return rows.questionnaire(x)


@query()
def stop_map(spark: SparkSession, folder: str) -> DataFrame:
    """The stop clusters of each track as points, each cluster in a colour of its own."""
    s = trips.find_stops(day_tracks(spark, folder))
    colours = F.array(*[F.lit(c) for c in encodings.hue_colours(24)])
    style = F.format_string('{"marker-color":"%s","stop":%d}', F.get(colours, (F.col("stop") % 24).cast("int")), F.col("stop"))
    g = s.groupBy("track").agg(F.sort_array(F.collect_list(F.struct("stop", "t", "id", encodings.point_feature(F.col("lat"), F.col("lon"), style).alias("f")))).alias("p"))
    return g.select("track", encodings.collection(F.transform("p", lambda p: p["f"])).alias("geojson"))


@query()
def pipeline_stages(spark: SparkSession, folder: str) -> DataFrame:
    """The whole way: raw records to the rows that stages are stored as."""
    return pipeline.stage_table(spark, folder, pipeline.run(spark, folder))


@query()
def pipeline_map(spark: SparkSession, folder: str) -> DataFrame:
    """Every trip of the whole way, its stages in the colours of their modes."""
    return pipeline.coloured_trips(pipeline.run(spark, folder))


@query()
def study_triples(spark: SparkSession, folder: str) -> DataFrame:
    """The stored stages of all trips as the graph of one experiment."""
    who = table(spark, folder, "trip").where("citizen_id is not null").select("trip_id", F.col("citizen_id").alias("user"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    p = table(spark, folder, "predictedstage").join(who, "trip_id").select("user", F.col("trip_id").alias("trip"), F.col("stage_id").alias("window"), "label", "prob", "modelinfo", us("starttimestamp").alias("s"), us("endtimestamp").alias("e"))
    t = p.groupBy("user", "trip").agg(F.min("s").alias("start_t"), F.max(F.coalesce("e", "s")).alias("end_t"))
    return provenance.study_graph(spark, STUDY.name, "1", {"detector": "stops", "ceps": str(STUDY.stop["ceps"]), "eps": str(STUDY.stop["eps"])}, t, p)

