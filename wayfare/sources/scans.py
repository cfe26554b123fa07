"""Scans of days, users and ranges of days, with the predicates where the reader can use them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.sources.tables import table


def scan_positions(
    spark: SparkSession, folder: str, day: str | None = None, users: Sequence[str] | DataFrame | None = None, below_m: float | None = None, first: str | None = None, last: str | None = None
) -> DataFrame:
    """Distinct rows of locationeventpertime of one ``day`` (yyyyMMdd) or of the days ``first`` to ``last``, of the given
    users (a list, or a frame with user_id), with an accuracy below ``below_m``."""
    return _scan(table(spark, folder, "locationeventpertime"), day, users, first, last, below_m).distinct()


def scan_accelerations(spark: SparkSession, folder: str, day: str | None = None, users: Sequence[str] | DataFrame | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """(user_id, day, event_id, timestamp, x, y, z) of accelerometerevent, axes as DOUBLE."""
    x = _scan(table(spark, folder, "accelerometerevent"), day, users, first, last, None)
    return x.select("user_id", "day", "event_id", "timestamp", *[F.col(c).cast("double").alias(c) for c in "xyz"])


def _scan(x: DataFrame, day, users, first, last, below_m) -> DataFrame:
    if day is not None:
        x = x.where(F.col("day") == day)
    if first is not None:
        x = x.where(F.col("day") >= first)
    if last is not None:
        x = x.where(F.col("day") <= last)
    if below_m is not None:
        x = x.where(F.col("accuracy") < below_m)
    if isinstance(users, DataFrame):
        return x.join(users.select("user_id"), "user_id", "left_semi")
    return x if users is None else x.where(F.col("user_id").isin(*users))


def allowed_users(spark: SparkSession, folder: str, mode: str | None = None) -> DataFrame:
    """(user_id) of the citizens of a collection mode, or of all."""
    c = table(spark, folder, "citizen")
    return (c if mode is None else c.where(F.coalesce("collection_mode", F.lit("CONTINUOUS")) == mode)).select(F.col("citizen_id").alias("user_id")).distinct()


def days_between(first: str, last: str) -> Iterator[str]:
    """Every day from ``first`` to ``last``, both yyyyMMdd and included."""
    a, b = (date(int(x[:4]), int(x[4:6]), int(x[6:])) for x in (first, last))
    while a <= b:
        yield a.strftime("%Y%m%d")
        a += timedelta(days=1)


def around(day: str, by: int) -> str:
    """The day ``by`` days after ``day``, both yyyyMMdd."""
    return (date(int(day[:4]), int(day[4:6]), int(day[6:])) + timedelta(days=by)).strftime("%Y%m%d")


def select_mapped(spark: SparkSession, statement: str, row: dict[str, str], **views: DataFrame) -> DataFrame:
    """The rows of a SQL statement over frames, each output column an expression over the statement's columns."""
    return spark.sql(statement, **views).select(*[F.expr(e).alias(name) for name, e in row.items()])
