"""Pairing records of two tables by nearest time for the same entity."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions.columns import floor_div
from wayfare.session import cut

#: Rows that one Arrow group is meant to hold, of both sides together.
GROUP_ROWS = 60_000
#: Width of a time bucket; a group of rows of one entity never spans more.
BUCKET_US = 600_000_000

#: What the join of one group may use before it spills; a group of ``GROUP_ROWS`` rows needs a few MB.
MEMORY = "512MB"

_ASOF = """
    SELECT l.entity, l.at,
           CASE WHEN f.at IS NULL OR l.at - b.at <= f.at - l.at THEN b.rid ELSE f.rid END AS rid
    FROM l
    ASOF LEFT JOIN r b ON l.entity = b.entity AND l.bucket = b.bucket AND l.at >= b.at
    ASOF LEFT JOIN r f ON l.entity = f.entity AND l.bucket = f.bucket AND l.at <= f.at
    WHERE least(coalesce(l.at - b.at, 9223372036854775807), coalesce(f.at - l.at, 9223372036854775807)) <= $tolerance
"""


def nearest_by_time(
    left: DataFrame,
    right: DataFrame,
    tolerance_us: int,
    left_cols: tuple[str, str, str],
    right_cols: tuple[str, str, str],
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(left_id, right_id): per left row the right row of the same entity nearest in time within ``tolerance_us``.

    ``left_cols`` and ``right_cols`` name entity, instant (BIGINT microseconds) and id. Of equally near
    right rows the earlier wins, then the smaller id. Rows with a null entity or instant match nothing;
    left rows without a match are left out; repeated left rows each get their match.

    Both sides are first reduced to one row per (entity, instant), with map-side combining, so copies
    cost nothing. Rows are then hashed by (entity, time bucket) into Arrow groups, right rows near a
    bucket's edge going to both buckets; so neither a hot entity nor a long one makes a hot group: a
    bucket holds at most as many rows as there are distinct instants in it. Inside a group DuckDB joins
    backward and forward by time. The matches are joined back to all left rows on (entity, instant).
    """
    width = max(BUCKET_US, 4 * tolerance_us)
    entity, at, rid = left_cols
    lefts = left.where(F.col(entity).isNotNull() & F.col(at).isNotNull()).select(
        F.col(entity).alias("entity"), F.col(at).alias("at"), F.col(rid).alias("left_id")
    )
    lefts = cut(lefts)
    entity, at, rid = right_cols
    rights = right.where(F.col(entity).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(entity).alias("entity"), F.col(at).alias("at"))
    rights = rights.agg(F.min(rid).alias("rid"))
    groups = max(1, math.ceil((lefts.count() + right.count()) / group_rows))
    group = F.pmod(F.xxhash64("entity", "bucket"), F.lit(groups)).cast("int")
    probe = lefts.select("entity", "at").distinct().withColumn("bucket", floor_div(F.col("at"), width))
    ends = F.array_distinct(F.array(floor_div(F.col("at") - tolerance_us, width), floor_div(F.col("at") + tolerance_us, width)))
    build = rights.withColumn("bucket", F.explode(ends))

    def join(_key: tuple, l: pa.Table, r: pa.Table) -> pa.Table:  # noqa: E741
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY}) as db:
            db.register("l", l)
            db.register("r", r)
            return db.sql(_ASOF, params={"tolerance": tolerance_us}).to_arrow_table()

    schema = f"entity {dict(lefts.dtypes)['entity']}, at bigint, rid bigint"
    matched = (
        probe.withColumn("g", group).groupBy("g")
        .cogroup(build.withColumn("g", group).groupBy("g"))
        .applyInArrow(join, schema)
    )
    return lefts.join(matched, ["entity", "at"]).select("left_id", F.col("rid").alias("right_id"))
