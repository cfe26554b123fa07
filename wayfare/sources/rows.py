"""Rows as studies store them: trips and stages with their ends as texts, addresses, paths and confidences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions import encodings


def _stamp(t: Column) -> Column:
    return F.date_format(F.timestamp_micros(t), "yyyy-MM-dd HH:mm:ss.SSS")


def _bare(c: Column) -> Column:
    """An address without quotation marks."""
    return F.replace(c, F.lit("'"), F.lit(""))


def _ends(user: Column, trace: Column) -> list[Column]:
    a, b = F.get(trace, 0), F.get(trace, F.size(trace) - 1)
    return [
        user.alias("citizen_id"), encodings.latlon(a["lat"], a["lon"]).alias("start_coordinate"), _stamp(a["t"]).alias("start_timestamp"),
        encodings.latlon(b["lat"], b["lon"]).alias("stop_coordinate"), _stamp(b["t"]).alias("stop_timestamp"),
    ]


def trip_rows(x: DataFrame) -> DataFrame:
    """Eight columns of a trip from (user, trace, start_address, stop_address); the trace is in order of time."""
    return x.select(*_ends(F.col("user"), F.col("trace")), "start_address", "stop_address", encodings.path(F.col("trace")).alias("path"))


def stage_rows(x: DataFrame, json_file: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Eleven columns of a stage from (user, trace, mode, confidence, start_address, stop_address, json_file_path); without
    ``json_file`` the older form, with segment_confidence in the place of the file's path. Columns to ``keep`` come first."""
    last = F.col("json_file_path") if json_file else F.coalesce("segment_confidence", F.lit(float("nan"))).alias("segment_confidence")
    return x.select(
        *keep, *_ends(F.col("user"), F.col("trace")), "start_address", "stop_address", F.col("mode").alias("transportation_mode"),
        F.col("confidence").alias("transportation_confidence"), encodings.path(F.col("trace")).alias("path"), last,
    )


def pilot_rows(x: DataFrame, mapped: str | None = None) -> DataFrame:
    """A stage with start, trace and end as one path and bare addresses; with ``mapped`` also the path of that trace, both
    paths as JSON arrays."""
    encode = encodings.path if mapped is None else encodings.json_path
    more = [] if mapped is None else [encode(F.col(mapped)).alias("path_mapped")]
    return x.select(
        *_ends(F.col("user"), F.col("trace")), _bare(F.col("start_address")).alias("start_address"), _bare(F.col("stop_address")).alias("stop_address"),
        F.col("mode").alias("transportation_mode"), F.col("confidence").alias("transportation_confidence"), encode(F.col("trace")).alias("path"), *more,
    )


def questionnaire(x: DataFrame) -> DataFrame:
    """(user, json) of what a user is asked about a trip, from (user, trace, start_address, stop_address, start_poi,
    stop_poi): both ends with address, place and time."""
    a, b = F.get("trace", 0), F.get(F.col("trace"), F.size("trace") - 1)

    def at(p: Column, name: str) -> Column:
        spot = F.array(p["lon"].cast("decimal(12,6)"), p["lat"].cast("decimal(12,6)"))
        return F.struct(spot.alias("point"), F.coalesce(f"{name}_address", F.lit("UNKNOWN_ADDRESS")).alias("address"), F.coalesce(f"{name}_poi", F.lit("UNKNOWN")).alias("poi"), _stamp(p["t"]).alias("datetime"))

    return x.select("user", F.to_json(F.struct(F.col("user").alias("uuid"), F.array(at(a, "start"), at(b, "stop")).alias("points"))).alias("json"))


def address_label(json: Column) -> Column:
    """The name in a geocoder's answer: name, else display_name, else the street; null for other texts."""
    name = F.coalesce(F.nullif(F.get_json_object(json, "$.name"), F.lit("")), F.nullif(F.get_json_object(json, "$.display_name"), F.lit("")))
    return F.coalesce(name, street_name(json))


def street_name(json: Column) -> Column:
    """The street in the first address of a geocoder's answer."""
    return F.nullif(F.get_json_object(json, "$.addresses[0].address.streetName"), F.lit(""))
