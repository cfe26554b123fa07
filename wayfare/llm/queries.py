"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.bpe import decode_ids, encode_texts, encode_words
from wayfare.llm.leakage import leaked_items, without_leaks
from wayfare.llm.nearest import nearest_by_time
from wayfare.llm.pieces import split_documents
from wayfare.llm.runs import collapse_runs
from wayfare.plans.sqltext import SQL_LOCATIONS, SQL_SHAKES
from wayfare.sources.tables import accelerations, locations, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    key = ("user_id", "instant_us", "event_id")
    pings = locations(spark, folder).select(*key)
    shakes = accelerations(spark, folder).select(*key)
    pairs = nearest_by_time(pings, shakes, 5_000_000, key, key)
    return pairs.select(F.col("left_id").alias("location_id"), F.col("right_id").alias("acc_id"))


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    stages = table(spark, folder, "predictedstage").select(
        "trip_id", "stage_id", "label",
        F.unix_micros(F.col("starttimestamp").cast("timestamp")).alias("s"),
        F.unix_micros(F.col("endtimestamp").cast("timestamp")).alias("e"),
    )
    return collapse_runs(stages, "trip_id", "stage_id", "label", "s", "e")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder).where("n >= 2").select(
        "trip_id", F.col("first_event").alias("first_stage_id"), F.col("last_event").alias("last_stage_id"), F.col("n").cast("long").alias("n_stages")
    )


def p4_runs(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder).select(
        "trip_id", "key", F.col("first_event").alias("first_stage_id"), F.col("last_event").alias("last_stage_id"),
        F.col("n").cast("long").alias("n_stages"), "start_us", "end_us", "duration_us",
    )


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents"), "doc_id", "text")


def p8_words(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct words of all texts with their counts and the ids that folding their ranked merges gives."""
    return encode_words(table(spark, folder, "documents"), "text")


def p8_decode(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, digest): every document encoded and decoded again, as the digest of the text that came out."""
    ids = encode_texts(table(spark, folder, "documents"), "doc_id", "text")
    return ids.select("doc_id", F.md5(decode_ids(F.col("ids")).cast("binary")).alias("digest"))


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    documents, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return leaked_items(documents, items, "doc_id", "text", "item_id", "text", layout="notebook_format")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_leaks(spark, folder).select("item_id", "doc_id")


def p9_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that hold no passage of any test item."""
    return without_leaks(table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars"), p9_leaks(spark, folder), "doc_id")


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_documents(table(spark, folder, "documents"), "doc_id", "text", layout="notebook_format")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p4_found, p4_runs, p8_ids, p8_words, p8_decode, p9_found, p9_leaks, p9_clean, p10_pieces)}

_RUNS = """
WITH k AS (
  SELECT trip_id, stage_id, epoch_us(starttimestamp) AS s, epoch_us(coalesce(endtimestamp, starttimestamp)) AS e,
         nullif(regexp_replace(lower(label), '[^a-z]', '', 'g'), '') AS key
  FROM predictedstage WHERE trip_id IS NOT NULL AND starttimestamp IS NOT NULL),
a AS (SELECT *, coalesce((key <> lag(key) OVER w)::int, 1) AS ch FROM k WINDOW w AS (PARTITION BY trip_id ORDER BY s, stage_id)),
b AS (SELECT *, sum(ch) OVER (PARTITION BY trip_id ORDER BY s, stage_id ROWS UNBOUNDED PRECEDING) AS g FROM a),
c AS (SELECT *, max(e) OVER (PARTITION BY trip_id, g ORDER BY s, stage_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS le FROM b),
d AS (SELECT *, sum(CASE WHEN le IS NULL OR s > le + 120000000 THEN 1 ELSE 0 END)
        OVER (PARTITION BY trip_id ORDER BY s, stage_id ROWS UNBOUNDED PRECEDING) AS r FROM c)
"""

ORACLES: dict[str, str] = {
    "p1_found": f"""WITH {SQL_LOCATIONS}, {SQL_SHAKES}, l AS (SELECT event_id, user_id, instant_us AS t FROM loc WHERE instant_us IS NOT NULL AND user_id IS NOT NULL),
r AS (SELECT user_id, instant_us AS t, min(event_id) AS rid FROM acc WHERE instant_us IS NOT NULL AND user_id IS NOT NULL GROUP BY 1, 2),
p AS (SELECT l.event_id, b.rid AS rid, l.t - b.t AS away, b.t FROM l ASOF JOIN r b ON b.user_id = l.user_id AND l.t >= b.t UNION ALL
  SELECT l.event_id, f.rid, f.t - l.t, f.t FROM l ASOF JOIN r f ON f.user_id = l.user_id AND l.t <= f.t)
SELECT event_id AS location_id, arg_min(rid, (away, t)) AS acc_id FROM p WHERE away <= 5000000 GROUP BY 1""",
    "p8_decode": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p4_found": _RUNS
    + """
SELECT trip_id, arg_min(stage_id, (s, stage_id)) AS first_stage_id, arg_max(stage_id, (s, stage_id)) AS last_stage_id, count(*)::bigint AS n_stages
FROM d GROUP BY trip_id, r HAVING count(*) >= 2""",
    "p4_runs": _RUNS
    + """
SELECT trip_id, any_value(key) AS key, arg_min(stage_id, (s, stage_id)) AS first_stage_id, arg_max(stage_id, (s, stage_id)) AS last_stage_id,
       count(*)::bigint AS n_stages, min(s)::bigint AS start_us, max(e)::bigint AS end_us, (max(e) - min(s))::bigint AS duration_us
FROM d GROUP BY trip_id, r""",
}
