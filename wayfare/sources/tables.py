"""Readers of the tables that the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.columns import scratch
from wayfare.functions.timestamps import compact_utc_us
from wayfare.operators.zones import normalise_instants


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_zone(spark: SparkSession, folder: str, df: DataFrame, key: str, zone: str) -> DataFrame:
    """Add the citizen's time zone; Catalyst broadcasts the citizen table only while it is small enough."""
    (k,) = scratch(df, 1, "__key")
    citizens = table(spark, folder, "citizen").select(F.col("citizen_id").alias(k), F.col("time_zone").alias(zone))
    return df.join(citizens, F.col(key) == F.col(k), "left").drop(k)


def locations(spark: SparkSession, folder: str) -> DataFrame:
    """locationeventpertime with ``instant_us``, the instant its timestamp denotes."""
    df = with_zone(spark, folder, table(spark, folder, "locationeventpertime"), "user_id", "zone")
    return normalise_instants(df, "user_id", "timestamp", "zone", "instant_us", day="day")


def accelerations(spark: SparkSession, folder: str) -> DataFrame:
    """accelerometerevent with ``instant_us``."""
    return table(spark, folder, "accelerometerevent").withColumn("instant_us", compact_utc_us(F.col("timestamp")))


def trips(spark: SparkSession, folder: str) -> DataFrame:
    """trip with ``start_us`` and ``stop_us``."""
    df = with_zone(spark, folder, table(spark, folder, "trip"), "citizen_id", "zone")
    df = normalise_instants(df, "citizen_id", "start_timestamp", "zone", "start_us")
    return df.withColumn("stop_us", F.unix_micros(F.col("stop_timestamp").cast("timestamp")))
