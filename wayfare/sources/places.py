"""Places as a dimension table, derived from the ends of trips, and lookups of them around points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.functions.geo import KM_PER_DEGREE, haversine_km
from wayfare.sources.tables import table

# Kinds of place.
CLASSES = ("RailwayStation", "BusStation", "Shop")
UNKNOWN = "UNKNOWN_ADDRESS"


def places(spark: SparkSession, folder: str) -> DataFrame:
    """(poi_id, label, cls, lat, lon): the addresses at which trips start, each once, under its smallest trip_id."""
    at = F.split(F.translate("start_coordinate", "[]", ""), ",")
    x = table(spark, folder, "trip").select("trip_id", F.col("start_address").alias("label"), F.get(at, 0).try_cast("double").alias("lat"), F.get(at, 1).try_cast("double").alias("lon"))
    x = x.where("label is not null and lat is not null and lon is not null").groupBy("label", "lat", "lon").agg(F.min("trip_id").alias("poi_id"))
    return x.select("poi_id", "label", F.get(F.array(*map(F.lit, CLASSES)), (F.col("poi_id") % 3).cast("int")).alias("cls"), "lat", "lon")


SQL_PLACES = (
    "po AS (SELECT poi_id, label, CASE poi_id % 3 WHEN 0 THEN 'RailwayStation' WHEN 1 THEN 'BusStation' ELSE 'Shop' END AS cls, lat, lon FROM (SELECT min(trip_id) AS poi_id, label, lat, lon FROM "
    "(SELECT trip_id, start_address AS label, try_cast(string_split(translate(start_coordinate, '[]', ''), ',')[1] AS double) AS lat, try_cast(string_split(translate(start_coordinate, '[]', ''), ',')[2] AS double) AS lon FROM trip) "
    "WHERE label IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL GROUP BY 2, 3, 4))"
)


def nearby(points: DataFrame, pois: DataFrame, radius_km: float, k: int) -> DataFrame:
    """(id, rank, poi_id, label, km): up to ``k`` places within ``radius_km`` of each point (id, lat, lon), nearest first,
    then by poi_id. Points meet places through an equi-join on grid cells of the radius: each place is put into its cell
    and the eight around it, so a point is compared with places of one cell only. Cells narrow with latitude by the
    widest row they touch. Points or places with a null position match nothing."""
    step = radius_km / KM_PER_DEGREE
    row = lambda lat: F.floor(lat / F.lit(step))
    # A column must be at least the radius wide at the row's end nearest a pole.
    wide = lambda r: F.lit(step) / F.greatest(F.least(F.cos(F.radians(r * step)), F.cos(F.radians((r + 1) * step))), F.lit(1e-3))
    around = F.explode(F.array(*[F.lit(x) for x in (-1, 0, 1)]))
    b = pois.select("poi_id", "label", F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    b = b.withColumn("dr", around).withColumn("r", row(F.col("plat")) + F.col("dr"))
    b = b.withColumn("dc", around).withColumn("c", F.floor(F.col("plon") / wide(F.col("r"))) + F.col("dc")).drop("dr", "dc")
    a = points.withColumn("r", row(F.col("lat"))).withColumn("c", F.floor(F.col("lon") / wide(F.col("r"))))
    km = haversine_km("lat", "lon", "plat", "plon")
    x = a.join(b, ["r", "c"]).withColumn("km", km).where(F.col("km") <= radius_km)
    w = Window.partitionBy("id").orderBy("km", "poi_id")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "rank", "poi_id", "label", "km")


def address_of(points: DataFrame, pois: DataFrame, radius_km: float) -> DataFrame:
    """(id, address): the label of the nearest place within the radius, else ``UNKNOWN``."""
    best = nearby(points, pois, radius_km, 1).select("id", F.col("label").alias("address"))
    return points.select("id").join(best, "id", "left").select("id", F.coalesce("address", F.lit(UNKNOWN)).alias("address"))
