"""From raw records to stored stages: positions, outliers, trips, samples, modes, cleaning, stages, rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import encodings
from wayfare.functions.timestamps import compact_utc_us
from wayfare.operators import modes, scoring, stages, trips
from wayfare.operators.trajectory import inside_spans
from wayfare.session import cut
from wayfare.settings import STUDY, Study
from wayfare.sources import rows
from wayfare.sources.places import address_of, places
from wayfare.sources.scans import around, scan_accelerations
from wayfare.sources.tracks import instant_tracks


@dataclass(frozen=True)
class Outcome:
    """What a run gives: points of trips, trips, predictions cleaned, and stages with their traces."""

    points: DataFrame
    trips: DataFrame
    predicted: DataFrame
    stages: DataFrame


def samples_of(spark: SparkSession, folder: str, ends: DataFrame, **scan) -> DataFrame:
    """(track, trip, id, t, x, y, z): the accelerations of a trip's user strictly within the trip."""
    a = scan_accelerations(spark, folder, **scan).where("x is not null and y is not null and z is not null and user_id is not null")
    a = a.select(F.col("user_id").alias("user"), F.col("event_id").alias("id"), F.inline(F.array(F.struct(compact_utc_us(F.col("timestamp")).alias("t")))), "x", "y", "z").where("t is not null")
    spans = ends.select(F.substring_index("track", "/", 1).alias("user"), "track", "trip", F.col("start_t").alias("a"), F.col("end_t").alias("b"))
    return inside_spans(a, spans, ["user"]).select("track", "trip", "id", "t", "x", "y", "z")


def run(
    spark: SparkSession, folder: str, day: str | None = None, users: DataFrame | None = None, scorer: scoring.Scorer | None = None, cleaning: scoring.Cleaning | None = None, study: Study = STUDY
) -> Outcome:
    """All stages of the positions of one local ``day`` (all days if not given), of ``users`` (user_id; all if not given).

    Trips are found on the tracks of each device and UTC day by the instants written. A trip with fewer than
    ``study.least_samples`` accelerations gets one guessed stage over the whole of it; the others are scored, each sample
    takes its best mode, modes are cleaned, and their changes projected onto the trip's trace."""
    points = cut(trips.extract_trips(instant_tracks(spark, folder, day, users), study))
    ends = cut(trips.trip_ends(points))
    # A local day lies within the UTC day of its name and the days beside it.
    near = {} if day is None else dict(zip(("first", "last"), (around(day, -1), around(day, 1))))
    samples = samples_of(spark, folder, ends, users=users, **near)
    enough = samples.groupBy("track", "trip").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= study.least_samples)
    samples = samples.join(enough.select("track", "trip"), ["track", "trip"], "left_semi")
    scored = scoring.predictions((scorer or scoring.ByShake()).score(samples))
    # From here on a trip is the track of the operators.
    of_trip = F.concat("track", F.lit("#"), F.col("trip").cast("string"))
    predicted = cut((cleaning or scoring.MajorityCleaning()).clean(scored.withColumn("track", of_trip).select("track", "id", "t", "mode", "prob")))
    known = predicted.select("track").distinct()
    trace = points.withColumn("track", of_trip).select("track", "id", "t", "lat", "lon")
    goal = ends.select(of_trip.alias("track"), F.col("end_t"), "end_lat", "end_lon", F.col("start_t"), F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon"))
    changes = modes.compress(predicted).select("track", "t", "mode")
    turns = stages.transition_points(trace.join(known, "track", "left_semi"), changes, study.default_mode)
    found = stages.stages(turns, goal.select("track", "end_t", "end_lat", "end_lon"))
    found = stages.stage_confidence(found, predicted).withColumn("model", F.lit("scored"))
    guessed = goal.join(known, "track", "left_anti").select(
        "track", F.lit(0).cast("long").alias("stage"), F.lit(study.default_mode).alias("mode"), "start_t", "end_t", "lat", "lon", "end_lat", "end_lon", F.lit(0.1).alias("confidence"), F.lit("guessed").alias("model")
    )
    every = cut(found.unionByName(guessed))
    return Outcome(points, ends, predicted, stages.stage_traces(every, trace))


def stage_table(spark: SparkSession, folder: str, outcome: Outcome, radius_km: float = 0.2) -> DataFrame:
    """(track, stage, eleven stored columns) of every stage, with the addresses of both its ends."""
    known = cut(outcome.stages.withColumn("json_file_path", F.concat(F.lit("stages/"), F.replace("track", F.lit("/"), F.lit("_")), F.lit("_"), F.col("stage").cast("string"), F.lit(".json"))))
    key = F.xxhash64("track", "stage")
    at = lambda lat, lon: known.select(key.alias("id"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    pois = cut(places(spark, folder))
    a = address_of(at("lat", "lon"), pois, radius_km).withColumnRenamed("address", "start_address")
    b = address_of(at("end_lat", "end_lon"), pois, radius_km).withColumnRenamed("address", "stop_address")
    x = known.withColumn("id", key).join(a, "id").join(b, "id").withColumn("user", F.substring_index("track", "/", 1))
    return rows.stage_rows(x, keep=("track", "stage"))


def coloured_trips(outcome: Outcome) -> DataFrame:
    """(trip, geojson): every trip with its stages in the colours of their modes."""
    g = outcome.stages.groupBy("track").agg(F.sort_array(F.collect_list(F.struct("stage", "mode", "trace"))).alias("s"))
    return g.select(F.col("track").alias("trip"), encodings.coloured_document(F.col("s")).alias("geojson"))
