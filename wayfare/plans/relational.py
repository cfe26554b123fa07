"""Queries on sources, joins, lookups and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import encodings
from wayfare.operators import provenance, trajectory
from wayfare.plans.registry import query
from wayfare.settings import STUDY
from wayfare.sources.places import SQL_PLACES, address_of, nearby, places
from wayfare.sources.tables import table
from wayfare.sources.tracks import SQL_MODES, SQL_TRACKS, SQL_W, day_tracks, mode_sequence, sql_km

R = lambda c, n=6: F.round(c, n)


@query("SELECT user_id, day, count(*)::bigint AS n FROM (SELECT DISTINCT user_id, day, timestamp, point.latitude AS lat, point.longitude AS lon, accuracy FROM locationeventpertime WHERE accuracy < 50) GROUP BY 1, 2")
def day_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct fixes per user and day with an accuracy better than 50 m."""
    d = table(spark, folder, "locationeventpertime").where("accuracy < 50").select("user_id", "day", "timestamp", "point.latitude", "point.longitude", "accuracy")
    return d.distinct().groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, point.longitude AS lon, point.latitude AS lat FROM locationeventpertime WHERE accuracy <= 50")
def accuracy_filter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "locationeventpertime").where("accuracy <= 50").select("event_id", F.col("point.longitude").alias("lon"), F.col("point.latitude").alias("lat"))


@query("SELECT user_id, day, count(*)::bigint AS n, round(avg(x::double), 6) AS mean_x, round(avg(y::double), 6) AS mean_y, round(avg(z::double), 6) AS mean_z FROM accelerometerevent WHERE abs(x) <= 160 AND abs(y) <= 160 AND abs(z) <= 160 GROUP BY 1, 2")
def acc_scan(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "accelerometerevent").where("abs(x) <= 160 and abs(y) <= 160 and abs(z) <= 160")
    return a.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"), *[R(F.avg(F.col(c).cast("double"))).alias(f"mean_{c}") for c in "xyz"])


@query("SELECT DISTINCT user_id FROM locationeventpertime")
def list_users(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "locationeventpertime").select("user_id").distinct()


@query("SELECT DISTINCT strftime(stop_timestamp, '%Y%m%d') AS day, citizen_id FROM trip WHERE stop_timestamp IS NOT NULL")
def users_with_data(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "trip").where("stop_timestamp is not null")
    return t.select(F.date_format("stop_timestamp", "yyyyMMdd").alias("day"), "citizen_id").distinct()


@query("SELECT citizen_id, coalesce(collection_mode, 'CONTINUOUS') AS mode, CASE WHEN collection_mode = 'ON-OFF' THEN 'window' ELSE 'cluster' END AS detector FROM citizen")
def citizen_mode(spark: SparkSession, folder: str) -> DataFrame:
    """The collection mode of each citizen, continuous where none is stated, and the trip detector it asks for."""
    mode = F.coalesce("collection_mode", F.lit("CONTINUOUS"))
    return table(spark, folder, "citizen").select("citizen_id", mode.alias("mode"), F.when(mode == "ON-OFF", "window").otherwise("cluster").alias("detector"))


@query("WITH m AS (SELECT date_trunc('month', max(stop_timestamp)) AS a FROM trip) SELECT citizen_id FROM citizen WHERE citizen_id NOT IN (SELECT citizen_id FROM trip, m WHERE stop_timestamp >= a AND citizen_id IS NOT NULL)")
def users_to_process(spark: SparkSession, folder: str) -> DataFrame:
    """Citizens without a trip in the last month that has any; the range on the plain column reaches the scan."""
    t = table(spark, folder, "trip")
    first = t.agg(F.date_trunc("month", F.max("stop_timestamp"))).first()[0]
    done = t.where(F.lit(False) if first is None else F.col("stop_timestamp") >= F.lit(first).cast("timestamp_ntz"))
    return table(spark, folder, "citizen").join(done.select("citizen_id"), "citizen_id", "left_anti").select("citizen_id")


@query("SELECT transportation_mode AS mode, count(*)::bigint AS n FROM trip GROUP BY 1")
def sql_passthrough(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql("SELECT transportation_mode AS mode, count(*) AS n FROM {trips} GROUP BY transportation_mode", trips=table(spark, folder, "trip"))


@query("SELECT t.trip_id, c.collection_mode FROM trip t JOIN citizen c ON c.citizen_id = t.citizen_id")
def trips_of_users(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "trip").join(table(spark, folder, "citizen"), "citizen_id").select("trip_id", "collection_mode")


@query("SELECT user_id, timestamp, n - 1 AS extra FROM (SELECT user_id, timestamp, count(*)::bigint AS n FROM locationeventpertime WHERE timestamp IS NOT NULL GROUP BY 1, 2) WHERE n > 1")
def bag_difference(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of the pings, as a bag, when each distinct (user, timestamp) is taken away once."""
    p = table(spark, folder, "locationeventpertime").where("timestamp is not null").select("user_id", "timestamp")
    return p.exceptAll(p.distinct()).groupBy("user_id", "timestamp").agg(F.count(F.lit(1)).alias("extra"))


@query(f"WITH {SQL_TRACKS}, {SQL_PLACES}, x AS (SELECT tr.id, po.poi_id, {sql_km('tr.lat', 'tr.lon', 'po.lat', 'po.lon')} AS km FROM tr JOIN po ON abs(tr.lat - po.lat) < 0.01), y AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, poi_id) AS rank FROM x WHERE km <= 0.5) SELECT id, rank::int AS rank, poi_id, round(km, 6) AS km FROM y WHERE rank <= 10")
def poi_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest places within half a kilometre of each point."""
    return nearby(day_tracks(spark, folder).select("id", "lat", "lon"), places(spark, folder), 0.5, 10).select("id", "rank", "poi_id", R("km").alias("km"))


@query(f"WITH {SQL_TRACKS}, {SQL_PLACES}, x AS (SELECT tr.id, po.label, po.poi_id, {sql_km('tr.lat', 'tr.lon', 'po.lat', 'po.lon')} AS km FROM tr JOIN po ON abs(tr.lat - po.lat) < 0.01), y AS (SELECT id, arg_min(label, (km, poi_id)) AS label FROM x WHERE km <= 0.2 GROUP BY 1) SELECT tr.id, coalesce(label, 'UNKNOWN_ADDRESS') AS address FROM tr LEFT JOIN y ON y.id = tr.id")
def address_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return address_of(day_tracks(spark, folder).select("id", "lat", "lon"), places(spark, folder), 0.2)


@query(f"WITH {SQL_PLACES} SELECT poi_id, label, cls FROM po WHERE cls IN ('RailwayStation', 'BusStation')")
def stations(spark: SparkSession, folder: str) -> DataFrame:
    return places(spark, folder).where(F.col("cls").isin("RailwayStation", "BusStation")).select("poi_id", "label", "cls")


@query(f"WITH {SQL_TRACKS} SELECT CASE WHEN count(*) >= {STUDY.large} THEN 'cluster' ELSE 'window' END AS detector, track FROM tr GROUP BY track")
def detector_choice(spark: SparkSession, folder: str) -> DataFrame:
    g = day_tracks(spark, folder).groupBy("track").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.when(F.col("n") >= STUDY.large, "cluster").otherwise("window").alias("detector"), "track")


@query(f"WITH {SQL_TRACKS} SELECT track, count(*)::bigint AS n FROM tr GROUP BY track HAVING count(*) >= {STUDY.least_samples}")
def enough_samples(spark: SparkSession, folder: str) -> DataFrame:
    g = day_tracks(spark, folder).groupBy("track").agg(F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= STUDY.least_samples)


@query(f"WITH {SQL_TRACKS}, n AS (SELECT id, row_number() OVER w - 1 AS rn FROM tr {SQL_W}) SELECT id, rn::bigint AS no FROM n")
def numbering(spark: SparkSession, folder: str) -> DataFrame:
    return day_tracks(spark, folder).select("id", (F.row_number().over(trajectory.along()) - 1).cast("long").alias("no"))


def _points_json() -> Column:
    return encodings.point_feature(F.col("lat"), F.col("lon"), F.format_string('{"id":%d}', F.col("id")))


_PT = """'{"type":"Feature","geometry":{"type":"Point","coordinates":' || printf('[%.6f,%.6f]', lon, lat) || '},"properties":' || printf('{"id":%d}', id) || '}'"""
_PATH = "'[' || string_agg(printf('[%.6f,%.6f]', lon, lat), ', ' ORDER BY t, id) || ']'"
_FC = """'{"type":"FeatureCollection","features":['"""


@query(f"WITH {SQL_TRACKS} SELECT track, {_FC} || string_agg({_PT}, ',' ORDER BY t, id) || ']}}' AS geojson FROM tr GROUP BY track")
def geojson_points(spark: SparkSession, folder: str) -> DataFrame:
    x = day_tracks(spark, folder).select("track", F.struct("t", "id", _points_json().alias("f")).alias("p"))
    g = x.groupBy("track").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return g.select("track", encodings.collection(F.transform("p", lambda p: p["f"])).alias("geojson"))


def _traces(spark: SparkSession, folder: str) -> DataFrame:
    g = day_tracks(spark, folder).groupBy("track")
    return g.agg(F.sort_array(F.collect_list(F.struct("t", "id", "lat", "lon"))).alias("trace"))


_LINE = f"""'{{"type":"Feature","geometry":{{"type":"LineString","coordinates":' || {_PATH} || '}},"properties":' || printf('{{"start":%d,"end":%d}}', min(t), max(t)) || '}}'"""


@query(f"WITH {SQL_TRACKS} SELECT track, {_FC} || {_LINE} || ']}}' AS geojson FROM tr GROUP BY track")
def geojson_linestring(spark: SparkSession, folder: str) -> DataFrame:
    props = F.format_string('{"start":%d,"end":%d}', F.array_min("trace")["t"], F.array_max("trace")["t"])
    return _traces(spark, folder).select("track", encodings.collection(F.array(encodings.line_feature(F.col("trace"), props))).alias("geojson"))


@query(f"WITH {SQL_TRACKS} SELECT track, {_FC} || string_agg({_PT}, ',' ORDER BY t, id) || ',' || {_LINE} || ']}}' AS geojson FROM tr GROUP BY track")
def geojson_merge(spark: SparkSession, folder: str) -> DataFrame:
    a = geojson_points(spark, folder).withColumnRenamed("geojson", "points")
    both = a.join(geojson_linestring(spark, folder).withColumnRenamed("geojson", "line"), "track")
    return both.select("track", encodings.merged(F.col("points"), F.col("line")).alias("geojson"))


@query(f"WITH {SQL_TRACKS} SELECT id, printf('{{\"id\":\"%s\",\"time\":%d,\"point\":\"POINT (%.6f %.6f)\"}}', track, t // 1000, lon, lat) AS sample FROM tr")
def map_match_samples(spark: SparkSession, folder: str) -> DataFrame:
    d = day_tracks(spark, folder)
    ms = ((F.col("t") - F.pmod(F.col("t"), F.lit(1000))) / 1000).cast("long")
    return d.select("id", encodings.sample(F.col("track"), ms, F.col("lat"), F.col("lon")).alias("sample"))


@query(f"WITH {SQL_TRACKS} SELECT track, {_PATH} AS path, printf('[%.6f,%.6f]', arg_min(lat, (t, id)), arg_min(lon, (t, id))) AS start_coordinate, printf('[%.6f,%.6f]', arg_max(lat, (t, id)), arg_max(lon, (t, id))) AS stop_coordinate FROM tr GROUP BY track")
def trip_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What the trip table stores of a track: its path and its ends (their axis orders differ)."""
    a, b = F.array_min("trace"), F.array_max("trace")
    return _traces(spark, folder).select(
        "track", encodings.path(F.col("trace")).alias("path"), encodings.latlon(a["lat"], a["lon"]).alias("start_coordinate"), encodings.latlon(b["lat"], b["lon"]).alias("stop_coordinate")
    )


@query(
    "SELECT stage_id, regexp_extract(modelinfo, '^([A-Za-z0-9_]+)\\(', 1) AS algorithm, len(string_split(regexp_extract(modelinfo, '\\((.*)\\)', 1), ','))::int AS n_settings, "
    "regexp_extract(modelinfo, '[(,]\\s*seed=([^,)]*)', 1) AS seed FROM predictedstage WHERE regexp_matches(modelinfo, '^[A-Za-z0-9_]+\\(.+\\)$')"
)
def model_info_parse(spark: SparkSession, folder: str) -> DataFrame:
    s = provenance.parse_model_info(table(spark, folder, "predictedstage"), "modelinfo").where("algorithm is not null")
    return s.select("stage_id", "algorithm", F.size("settings").alias("n_settings"), F.coalesce(F.element_at("settings", "seed"), F.lit("")).alias("seed"))


@query("SELECT trip_id, '{\"uuid\":\"' || citizen_id || '\",\"points\":[{\"point\":' || start_coordinate || ',\"address\":\"' || coalesce(start_address, 'UNKNOWN_ADDRESS') || '\"},{\"point\":' || stop_coordinate || ',\"address\":\"' || coalesce(stop_address, 'UNKNOWN_ADDRESS') || '\"}]}' AS json FROM trip WHERE citizen_id IS NOT NULL AND start_coordinate IS NOT NULL AND stop_coordinate IS NOT NULL")
def questionnaire_json(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "trip").dropna(subset=["citizen_id", "start_coordinate", "stop_coordinate"])
    at = lambda e: F.struct(F.from_json(f"{e}_coordinate", "array<decimal(12,6)>").alias("point"), F.coalesce(f"{e}_address", F.lit("UNKNOWN_ADDRESS")).alias("address"))
    return t.select("trip_id", F.to_json(F.struct(F.col("citizen_id").alias("uuid"), F.array(at("start"), at("stop")).alias("points"))).alias("json"))


_FACTS = """WITH p AS (SELECT *, regexp_extract(modelinfo, '^([A-Za-z0-9_]+)\\(', 1) AS algo, regexp_matches(modelinfo, '^[A-Za-z0-9_]+\\(.+\\)$') AS good, 'urn:study:stage/' || stage_id AS st, 'urn:study:run/' || sha256(modelinfo) AS run FROM predictedstage),
e AS (SELECT stage_id, run, trim(split_part(x, '=', 1)) AS k, trim(regexp_replace(x, '^[^=]*=?', '')) AS v, i FROM (SELECT stage_id, run, unnest(string_split(regexp_extract(modelinfo, '\\((.*)\\)', 1), ',')) AS x, generate_subscripts(string_split(regexp_extract(modelinfo, '\\((.*)\\)', 1), ','), 1) AS i FROM p WHERE good)),
t AS (SELECT st AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 'http://www.w3.org/ns/prov#Entity' AS o, 'iri' AS o_type FROM p
UNION ALL SELECT st, 'http://www.w3.org/ns/prov#wasDerivedFrom', 'urn:study:trip/' || trip_id, 'iri' FROM p
UNION ALL SELECT st, 'http://purl.org/dc/elements/1.1/type', label, 'literal' FROM p UNION ALL SELECT st, 'http://www.w3.org/ns/mls#hasValue', prob::varchar, 'literal' FROM p
UNION ALL SELECT st, 'http://www.w3.org/ns/prov#wasGeneratedBy', run, 'iri' FROM p WHERE good UNION ALL SELECT run, 'http://www.w3.org/ns/mls#executes', 'urn:study:implementation/' || algo, 'iri' FROM p WHERE good
UNION ALL SELECT 'urn:study:implementation/' || algo, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://www.w3.org/ns/mls#Implementation', 'iri' FROM p WHERE good
UNION ALL SELECT run, 'urn:study:setting/' || k, arg_min(v, i), 'literal' FROM e GROUP BY stage_id, run, k)
SELECT DISTINCT s, p, o, o_type FROM t WHERE s IS NOT NULL AND o IS NOT NULL"""


@query(_FACTS)
def provenance_triples(spark: SparkSession, folder: str) -> DataFrame:
    """What was predicted by which model with which settings, as distinct subject, predicate, object triples."""
    return provenance.triples(table(spark, folder, "predictedstage"))


@query(f"WITH {SQL_MODES} SELECT id, CASE mode " + " ".join(f"WHEN '{m}' THEN '{c}'" for m, c in encodings.COLOURS.items()) + " END AS colour FROM mo")
def mode_colours(spark: SparkSession, folder: str) -> DataFrame:
    return mode_sequence(spark, folder).select("id", encodings.colour(F.col("mode")).alias("colour"))


@query("WITH v AS (SELECT trip_id, label, prob FROM predictedstage WHERE label IS NOT NULL) SELECT trip_id, count(*)::bigint AS n, round(avg(prob), 6) AS mean_prob, count(DISTINCT label)::bigint AS labels FROM v GROUP BY 1")
def stages_per_trip(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "predictedstage").where("label is not null")
    return v.groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"), R(F.avg("prob")).alias("mean_prob"), F.count_distinct("label").alias("labels"))
