"""Queries on mode sequences, stages, features and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators import features, modes, stages, trajectory
from wayfare.plans.registry import query
from wayfare.settings import STUDY
from wayfare.sources.tables import table
from wayfare.sources.tracks import (
    SQL_MODES, SQL_PAIRS, SQL_SENSOR, SQL_SPANS, SQL_TRACKS, SQL_W, day_tracks, mode_sequence, sensor_rows, sql_bearing, sql_km, stage_trips,
)

LABELS = ["walk", "bike", "car", "bus", "train", "still"]
_LIST = "[" + ", ".join(f"'{m}'" for m in LABELS) + "]"
R = lambda c, n=6: F.round(c, n)


def _probs(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 1000).alias("track"), F.col("vec_id").alias("id"), F.col("vec_id").alias("t"), F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double")).alias("probs"))


@query(f"SELECT vec_id AS id, {_LIST}[list_position(embedding[1:6], list_max(embedding[1:6]))] AS mode FROM embeddings")
def best_mode(spark: SparkSession, folder: str) -> DataFrame:
    return _probs(spark, folder).select("id", modes.best_mode(F.col("probs"), LABELS).alias("mode"))


@query(f"WITH {SQL_MODES}, l AS (SELECT *, lag(mode) OVER w AS was FROM mo {SQL_W}) SELECT id, mode FROM l WHERE was IS NULL OR was <> mode")
def mode_compress(spark: SparkSession, folder: str) -> DataFrame:
    return modes.compress(mode_sequence(spark, folder)).select("id", "mode")


_MOVING = [m for m in LABELS if m != "still"]


def _sql_vote(source: str, out: str, frame: str) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE mode = '{m}') OVER ({frame}) AS c_{m}" for m in _MOVING)
    top = "greatest(" + ", ".join(f"c_{m}" for m in _MOVING) + ")"
    pick = " ".join(f"WHEN c_{m} = {top} THEN '{m}'" for m in _MOVING)
    vote = f"CASE WHEN {top} = 0 THEN 'still' {pick} END"
    return f"{out}0 AS (SELECT *, {counts} FROM {source}), {out} AS (SELECT * EXCLUDE ({', '.join('c_' + m for m in _MOVING)}) REPLACE ({vote} AS mode, CASE WHEN {vote} = mode THEN prob ELSE 1e-6::double END AS prob) FROM {out}0)"


_FRAME = "PARTITION BY track ORDER BY t, id ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING"
_CLEAN = f"{SQL_MODES}, {_sql_vote('mo', 'v1', _FRAME)}, {_sql_vote('v1', 'v2', _FRAME)}, {_sql_vote('v2', 'v3', _FRAME)}"


@query(f"WITH {_CLEAN} SELECT id, mode, round(prob, 9) AS prob FROM v3")
def majority_vote(spark: SparkSession, folder: str) -> DataFrame:
    return modes.majority_vote(mode_sequence(spark, folder), 12, 3).select("id", "mode", R("prob", 9).alias("prob"))


@query(f"WITH {SQL_MODES}, b AS (SELECT *, (row_number() OVER w - 1) // 10 AS batch FROM mo {SQL_W}), {_sql_vote('b', 'v', 'PARTITION BY track, batch')} SELECT id, mode, round(prob, 9) AS prob FROM v")
def majority_vote_batched(spark: SparkSession, folder: str) -> DataFrame:
    return modes.majority_vote_batched(mode_sequence(spark, folder), 10).select("id", "mode", R("prob", 9).alias("prob"))


@query(
    "WITH s AS (SELECT vec_id AS id, "
    + ", ".join(f"round(sum(embedding[{k}]::double) OVER (PARTITION BY vec_id // 1000 ORDER BY vec_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 9) AS s{k}" for k in range(1, 7))
    + " FROM embeddings) SELECT id, list_position([s1, s2, s3, s4, s5, s6], greatest(s1, s2, s3, s4, s5, s6))::bigint AS winner FROM s"
)
def weighted_vote(spark: SparkSession, folder: str) -> DataFrame:
    return modes.weighted_vote(_probs(spark, folder), 5, 6).select("id", "winner")


_ASOF = f"{SQL_TRACKS}, {SQL_MODES}, ch AS (SELECT * FROM (SELECT *, lag(mode) OVER w AS was FROM mo {SQL_W}) WHERE was IS NULL OR was <> mode)"


@query(f"WITH {_ASOF} SELECT tr.id, ch.mode FROM tr ASOF LEFT JOIN ch ON tr.track = ch.track AND tr.t > ch.t")
def asof_mode(spark: SparkSession, folder: str) -> DataFrame:
    """The last mode change strictly before each point: one sort of points and changes together, no range join."""
    changes = modes.compress(mode_sequence(spark, folder)).select("track", "t", F.lit(1).alias("side"), F.lit(None).cast("long").alias("id"), "mode")
    points = day_tracks(spark, folder).select("track", "t", F.lit(0).alias("side"), "id", F.lit(None).cast("string").alias("mode"))
    w = trajectory.Window.partitionBy("track").orderBy("t", "side").rowsBetween(trajectory.Window.unboundedPreceding, 0)
    x = points.unionByName(changes).withColumn("last", F.last("mode", ignorenulls=True).over(w))
    return x.where("side = 0").select("id", F.col("last").alias("mode"))


def _points(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = modes.majority_vote(mode_sequence(spark, folder), STUDY.vote_rows, 1)
    return stages.transition_points(day_tracks(spark, folder), modes.compress(cleaned).select("track", "t", "mode"), STUDY.default_mode)


def _sql_split(t: str) -> tuple[str, str]:
    """Latitude and longitude on a hop from (lat, lon) to (lat2, lon2) at time ``t`` of it."""
    r = f"({sql_km('lat', 'lon', 'lat2', 'lon2')} * (({t} - t) / (t2 - t)) / 6378.1::double)"
    b = f"radians({sql_bearing('lat', 'lon', 'lat2', 'lon2')})"
    la = f"asin(sin(radians(lat)) * cos({r}) + cos(radians(lat)) * sin({r}) * cos({b}))"
    return f"degrees({la})", f"degrees(radians(lon) + atan2(sin({b}) * sin({r}) * cos(radians(lat)), cos({r}) - sin(radians(lat)) * sin({la})))"


_VOTED = f"PARTITION BY track ORDER BY t, id ROWS BETWEEN {STUDY.vote_rows} PRECEDING AND {STUDY.vote_rows} FOLLOWING"
_AT = _sql_split("l[j].t")
_TRANSITIONS = f"""{SQL_PAIRS}, {SQL_MODES}, {_sql_vote("mo", "v1", _VOTED)},
ch AS (SELECT track, t, mode FROM (SELECT *, lag(mode) OVER w AS was FROM v1 {SQL_W}) WHERE was IS NULL OR was <> mode),
c0 AS (SELECT track, arg_min(mode, t) AS mode FROM ch GROUP BY 1),
ins AS (SELECT pr.track, pr.id, list({{'t': ch.t, 'mode': ch.mode}} ORDER BY ch.t) AS l FROM pr JOIN ch ON ch.track = pr.track AND ch.t > pr.t AND ch.t < pr.t2 GROUP BY 1, 2),
h AS (SELECT pr.*, l, coalesce(len(l), 0) AS n, b.mode AS before, c0.mode AS head FROM pr LEFT JOIN ins ON ins.id = pr.id ASOF LEFT JOIN ch b ON b.track = pr.track AND pr.t > b.t LEFT JOIN c0 ON c0.track = pr.track),
tp AS (SELECT track, id, 0 AS j, t, lat, lon, CASE WHEN head IS NULL THEN '{STUDY.default_mode}' WHEN n = 0 THEN coalesce(before, head) WHEN n = 1 THEN coalesce(before, l[1].mode) ELSE l[1].mode END AS mode FROM h
  UNION ALL SELECT track, id, j, l[j].t, {_AT[0]}, {_AT[1]}, CASE WHEN n = 1 OR j < n THEN l[j].mode ELSE l[j - 1].mode END FROM (SELECT *, unnest(range(CASE WHEN n = 1 THEN 1 ELSE 2 END, n + 1)) AS j FROM h WHERE n > 0)),
tc AS (SELECT track, t, lat, lon, mode FROM (SELECT *, lag(mode) OVER v AS was FROM tp WINDOW v AS (PARTITION BY track ORDER BY t, id, j)) WHERE was IS NULL OR was <> mode)"""
SQL_STAGES = f"""{_TRANSITIONS}, en AS (SELECT track, max(t) AS end_t FROM tr GROUP BY 1),
sg AS (SELECT tc.track, row_number() OVER s - 1 AS stage, mode, t AS start_t, lead(t) OVER s AS nx, count(*) OVER (PARTITION BY tc.track) AS points, end_t FROM tc JOIN en ON en.track = tc.track WINDOW s AS (PARTITION BY tc.track ORDER BY t, mode)),
sf AS (SELECT sg.track, stage, sg.mode, start_t, coalesce(nx, sg.end_t) AS end_t, nx, points FROM sg)"""
_CONFIDENT = "SELECT sf.track, stage, sf.mode, start_t, end_t, coalesce(sum(p.prob::decimal(18,12))::double / nullif(count(p.prob), 0), 0) AS confidence FROM sf LEFT JOIN mo p ON p.track = sf.track AND p.mode = sf.mode AND p.t BETWEEN start_t AND end_t AND NOT isnan(p.prob)"


@query(f"WITH {_TRANSITIONS} SELECT track, t, round(lat, 6) AS lat, round(lon, 6) AS lon, mode FROM tc")
def transition_points(spark: SparkSession, folder: str) -> DataFrame:
    p = _points(spark, folder)
    return p.select("track", "t", R("lat").alias("lat"), R("lon").alias("lon"), "mode")


def _ends(tracks: DataFrame) -> DataFrame:
    """Each track's last point."""
    return tracks.groupBy("track").agg(F.max(F.struct("t", "id", "lat", "lon")).alias("e")).select("track", F.col("e.t").alias("end_t"), F.col("e.lat").alias("end_lat"), F.col("e.lon").alias("end_lon"))


def _stages(spark: SparkSession, folder: str, keep_last: bool) -> DataFrame:
    s = stages.stages(_points(spark, folder), _ends(day_tracks(spark, folder)), keep_last)
    s = stages.stage_confidence(s, mode_sequence(spark, folder))
    return s.select("track", "stage", "mode", "start_t", "end_t", "confidence")


@query(f"WITH {SQL_STAGES} {_CONFIDENT} GROUP BY 1, 2, 3, 4, 5")
def stages_all(spark: SparkSession, folder: str) -> DataFrame:
    return _stages(spark, folder, True)


@query(f"WITH {SQL_STAGES} {_CONFIDENT} WHERE nx IS NOT NULL OR points = 1 GROUP BY 1, 2, 3, 4, 5")
def stages_strict(spark: SparkSession, folder: str) -> DataFrame:
    return _stages(spark, folder, False)


@query(f"WITH {SQL_SENSOR}, {SQL_SPANS} SELECT trip_id, count(*)::bigint AS n, round(avg(sqrt(x * x + y * y + z * z)), 6) AS mean_norm FROM se JOIN sp ON se.user_id = u AND t > a AND t < b GROUP BY 1")
def acc_in_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Accelerations strictly within each trip of their user, joined on user and hour."""
    rows = sensor_rows(spark, folder).withColumn("user", F.substring_index("track", "/", 1))
    x = trajectory.inside_spans(rows, stage_trips(spark, folder), ["user"])
    return x.groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"), R(F.avg(features.norm3("x", "y", "z"))).alias("mean_norm"))


_BY_TRIP = "st AS (SELECT trip_id, stage_id, epoch_us(starttimestamp) AS s, epoch_us(coalesce(endtimestamp, starttimestamp)) AS e FROM predictedstage WHERE starttimestamp IS NOT NULL AND trip_id IS NOT NULL)"


@query(
    f"WITH {SQL_SENSOR}, {SQL_SPANS}, {_BY_TRIP}, sa AS (SELECT trip_id, min(t) AS lo, max(t) AS hi FROM se JOIN sp ON se.user_id = u AND t > a - 60000000 AND t < b + 60000000 GROUP BY 1), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY s, stage_id) AS i, count(*) OVER (PARTITION BY trip_id) AS c FROM st) "
    "SELECT stage_id, CASE WHEN i = 1 THEN coalesce(lo, s) ELSE s END AS start_us, CASE WHEN i = c THEN coalesce(hi, e) ELSE e END AS end_us FROM n LEFT JOIN sa USING (trip_id)"
)
def boundary_widening(spark: SparkSession, folder: str) -> DataFrame:
    """The first stage of a trip begins with the trip's samples, of a minute around it, and the last ends with them."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    s = table(spark, folder, "predictedstage").where("starttimestamp is not null and trip_id is not null").select(
        "trip_id", "stage_id", us(F.col("starttimestamp")).alias("start_us"), us(F.coalesce("endtimestamp", "starttimestamp")).alias("end_us")
    )
    rows = sensor_rows(spark, folder).select(F.substring_index("track", "/", 1).alias("user"), "t")
    spans = stage_trips(spark, folder).select("user", "trip_id", (F.col("a") - 60_000_000).alias("a"), (F.col("b") + 60_000_000).alias("b"))
    x = trajectory.inside_spans(rows, spans, ["user"]).groupBy("trip_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return stages.widen_ends(s, x).drop("trip_id")


@query(
    f"WITH {SQL_MODES}, st AS (SELECT track, id, mode, t AS a, coalesce(lead(t) OVER w, t + 3600000000) AS b FROM mo {SQL_W}) "
    "SELECT st.id, coalesce(sum(p.prob::decimal(18,12))::double / nullif(count(p.prob), 0), 0) AS confidence FROM st LEFT JOIN mo p ON p.track = st.track AND p.mode = st.mode AND p.t BETWEEN st.a AND st.b AND NOT isnan(p.prob) GROUP BY st.id"
)
def stage_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """The mean probability of every mode from each prediction of it to the next prediction, both ends included."""
    m = mode_sequence(spark, folder)
    until = F.coalesce(F.lead("t").over(trajectory.along()), F.col("t") + 3_600_000_000)
    s = m.select("track", "id", "mode", F.col("t").alias("start_t"), until.alias("end_t"))
    return stages.stage_confidence(s, m).select("id", "confidence")


@query("WITH n AS (SELECT trip_id, count(*) AS k FROM predictedstage WHERE starttimestamp IS NOT NULL GROUP BY 1) SELECT t.trip_id, coalesce(p.label, 'car') AS mode, CASE WHEN n.k IS NULL THEN 0.1::double ELSE round(p.prob, 6) END AS prob, CASE WHEN n.k IS NULL THEN 'guessed' ELSE 'model' END AS source FROM trip t LEFT JOIN n ON n.trip_id = t.trip_id LEFT JOIN predictedstage p ON p.trip_id = t.trip_id AND p.starttimestamp IS NOT NULL")
def fallback_stage(spark: SparkSession, folder: str) -> DataFrame:
    trips = table(spark, folder, "trip").select("trip_id", F.lit(None).cast("timestamp_ntz").alias("trip_start_t"), F.col("stop_timestamp").cast("timestamp_ntz").alias("trip_end_t"))
    s = table(spark, folder, "predictedstage").where("starttimestamp is not null").select(
        "trip_id", F.coalesce("label", F.lit("car")).alias("mode"), F.col("starttimestamp").cast("timestamp_ntz").alias("start_t"), F.col("endtimestamp").cast("timestamp_ntz").alias("end_t"), "prob", F.lit("model").alias("model")
    )
    return modes.fallback_stage(trips, s, "trip_id").select("trip_id", "mode", R("prob").alias("prob"), F.col("model").alias("source"))


@query("SELECT event_id, round(sqrt(x::double * x + y::double * y + z::double * z), 4) AS norm FROM accelerometerevent WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND abs(x) <= 160 AND abs(y) <= 160 AND abs(z) <= 160")
def acc_norm(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "accelerometerevent").where("abs(x) <= 160 and abs(y) <= 160 and abs(z) <= 160")
    return a.select("event_id", R(features.norm3(*[F.col(c).cast("double") for c in "xyz"]), 4).alias("norm"))


@query(f"WITH {SQL_SENSOR}, n AS (SELECT *, sqrt(x * x + y * y + z * z) AS norm FROM se), w AS (SELECT id, list(norm) OVER v AS l, list(label) OVER v AS labels FROM n WINDOW v AS (PARTITION BY track ORDER BY t, id ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) SELECT id, round(list_sum(l), 6) AS total, round(l[1], 6) AS first, round(l[8], 6) AS last FROM w WHERE len(l) = 8")
def sliding_norm_windows(spark: SparkSession, folder: str) -> DataFrame:
    x = features.sliding_norms(sensor_rows(spark, folder), 8)
    return x.select("id", R(F.aggregate("norms", F.lit(0.0), lambda a, b: a + b)).alias("total"), R(F.col("norms")[0]).alias("first"), R(F.col("norms")[7]).alias("last"))


@query(f"WITH {SQL_SENSOR}, w AS (SELECT id, list(label) OVER v AS l FROM se WINDOW v AS (PARTITION BY track ORDER BY t, id ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)), u AS (SELECT id, unnest(l) AS label FROM w WHERE len(l) = 8), c AS (SELECT id, label, count(*) AS n FROM u GROUP BY 1, 2) SELECT id, arg_min(label, (-n, label)) AS label FROM c GROUP BY 1")
def common_label(spark: SparkSession, folder: str) -> DataFrame:
    return features.sliding_norms(sensor_rows(spark, folder), 8).select("id", "label")


_WIDTH = 64


def _sql_haar(width: int, digits: int = 6) -> str:
    """The coefficients of ``width`` values ``v``: from coarse to fine, the first half of each block less the second."""
    part = lambda a, n: f"list_sum(v[{a + 1}:{a + n}])"
    h = [f"{part(0, width)} / sqrt({width}.0::double)"]
    n = width
    while n > 1:
        h += [f"({part(a, n // 2)} - {part(a + n // 2, n // 2)}) / sqrt({n}.0::double)" for a in range(0, width, n)]
        n //= 2
    return ", ".join(f"round({x}, {digits}) AS h{k}" for k, x in enumerate(h))


@query(f"WITH e AS (SELECT vec_id AS id, CASE WHEN len(embedding) = {_WIDTH} THEN embedding::double[] END AS v FROM embeddings) SELECT id, {_sql_haar(_WIDTH)} FROM e")
def haar_features_full(spark: SparkSession, folder: str) -> DataFrame:
    """(id, h0 ... h63): the transform of all values of each embedding; nulls where there are not 64."""
    v = F.when(F.size("embedding") == _WIDTH, F.transform("embedding", lambda x: x.cast("double")))
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), features.haar(v, _WIDTH).alias("h"))
    return e.select("id", *[R(F.col("h")[k]).alias(f"h{k}") for k in range(_WIDTH)])


@query(
    f"WITH e AS (SELECT vec_id AS id, CASE WHEN len(embedding) = {_WIDTH} THEN embedding::double[] END AS v FROM embeddings), h AS (SELECT id, {_sql_haar(_WIDTH, 12)} FROM e) SELECT id, round(h0 * h0, 6) AS e0, "
    + ", ".join("round(" + " + ".join(f"h{k} * h{k}" for k in range(2**j, 2 ** (j + 1))) + f", 6) AS e{j + 1}" for j in range(6))
    + " FROM h"
)
def haar_features(spark: SparkSession, folder: str) -> DataFrame:
    """(id, e0 ... e6): the energy of each embedding's transform by level, from the approximation to the finest detail."""
    v = F.when(F.size("embedding") == _WIDTH, F.transform("embedding", lambda x: x.cast("double")))
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), features.haar(v, _WIDTH).alias("h"))
    part = lambda a, n: F.aggregate(F.transform(F.slice("h", a, n), lambda x: x * x), F.lit(0.0), lambda x, y: x + y)
    return e.select("id", R(part(1, 1)).alias("e0"), *[R(part(2**j + 1, 2**j)).alias(f"e{j + 1}") for j in range(6)])


@query(f"WITH {SQL_SENSOR}, w AS (SELECT id, avg(sqrt(x * x + y * y + z * z)) OVER v AS m, count(*) OVER v AS n FROM se WINDOW v AS (PARTITION BY track ORDER BY t, id ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) SELECT id, round(m, 6) AS mean FROM w WHERE n = 50")
def activity_windows(spark: SparkSession, folder: str) -> DataFrame:
    return features.activity_windows(sensor_rows(spark, folder), 50).select("id", R("mean").alias("mean"))


@query("SELECT count(DISTINCT label)::bigint AS n FROM embeddings")
def label_count(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").agg(F.count_distinct("label").alias("n"))


@query()
def mlp_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out predictions of a perceptron trained on Haar features of the embeddings."""
    from wayfare.operators.learning import perceptron_predictions

    return perceptron_predictions(table(spark, folder, "embeddings"), "vec_id", "embedding", "label")
