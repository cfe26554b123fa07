"""Readers of delimited files and GPX, and writers of tables, texts and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.timestamps import compact_utc_us


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """timestamp, latitude, longitude, altitude with a header, quoted; adds ``t``, microseconds of the wall clock."""
    df = spark.read.csv(path, header=True, schema="timestamp string, latitude double, longitude double, altitude double")
    return df.withColumn("t", compact_utc_us(F.rpad("timestamp", 17, "0")))


def read_accelerations(spark: SparkSession, path: str) -> DataFrame:
    """timestamp, x, y, z with a header; adds ``t``."""
    df = spark.read.csv(path, header=True, schema="timestamp string, x double, y double, z double")
    return df.withColumn("t", compact_utc_us(F.rpad("timestamp", 17, "0")))


def read_probabilities(spark: SparkSession, path: str, labels: list[str]) -> DataFrame:
    """One probability per label and row, with a header; as an array column ``probs``."""
    df = spark.read.csv(path, header=True, schema=", ".join(f"`{c}` double" for c in labels))
    return df.select(F.array(*[F.col(f"`{c}`") for c in labels]).alias("probs"))


def read_stages(spark: SparkSession, path: str) -> DataFrame:
    """label, start, end, prob and, as the rest of the line with its commas, the model; blank lines are left out."""
    parts = F.split("value", ",", 5)
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(
        F.get(parts, 0).alias("label"), F.get(parts, 1).try_cast("timestamp").alias("start"), F.get(parts, 2).try_cast("timestamp").alias("end"),
        F.get(parts, 3).try_cast("double").alias("prob"), F.get(parts, 4).alias("model"),
    )


def write_delimited(df: DataFrame, path: str, columns: list[str], separator: str = ",") -> None:
    df.select(*columns).write.mode("overwrite").csv(path, header=True, sep=separator)


def write_documents(df: DataFrame, path: str, text: str, partition: str | None = None) -> None:
    """One line per row of ``text``, in a folder per value of ``partition`` if given."""
    out = df.select(F.col(text).alias("value"), *([partition] if partition else []))
    writer = out.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).text(path)


def write_window_stats(stats: DataFrame, path: str) -> None:
    """Tab-separated statistics of tumbling windows, see ``trajectory.tumbling_stats``."""
    # The names of the columns.
    names = {"win": "window_start", "n": "#entries", "first_id": "first_entry", "last_id": "last_entry", "degrees": "l2-norm", "km": "distance_start_end(km)", "path_km": "distance_sum(km)", "kmh": "avg. km/h"}
    write_delimited(stats.select(*[F.col(a).alias(b) for a, b in names.items()]), path, list(names.values()), "\t")


def export_positions(rows: DataFrame, path: str, altitude: bool = True) -> None:
    """Positions of a scan: timestamp, latitude, longitude, altitude, or timestamp, longitude, latitude."""
    x = rows.select("timestamp", "point.latitude", "point.longitude", "point.altitude")
    write_delimited(x, path, ["timestamp", "latitude", "longitude", "altitude"] if altitude else ["timestamp", "longitude", "latitude"])


def export_accelerations(rows: DataFrame, path: str) -> None:
    write_delimited(rows, path, ["timestamp", "x", "y", "z"])


def write_day(trips: DataFrame, path: str) -> None:
    """Each track's points and each trip's, as one line per trip (track, trip, geojson), in a folder per track."""
    write_documents(trips, path, "geojson", "track")


def append_rows(df: DataFrame, target: str, table: str, properties: dict[str, str] | None = None) -> None:
    """Append to a JDBC table if ``target`` is a JDBC address, else to a Parquet folder of the table's name."""
    if target.startswith("jdbc:"):
        df.write.jdbc(target, table, mode="append", properties=properties or {})
    else:
        df.write.mode("append").parquet(f"{target}/{table}")


def gpx(trace: DataFrame, group: str, segment: str | None = None) -> DataFrame:
    """(group, gpx): one GPX track per group of (t, lat, lon) rows in order of time, in segments by ``segment`` if given."""
    x = trace.withColumn("__s", F.col(segment) if segment else F.lit(0))
    parts = x.groupBy(group, "__s").agg(F.sort_array(F.collect_list(F.struct("t", "lat", "lon"))).alias("p"))
    point = lambda p: F.concat(F.format_string('<trkpt lat="%.6f" lon="%.6f"><time>', p["lat"], p["lon"]), F.date_format(F.timestamp_micros(p["t"]), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("</time></trkpt>"))
    parts = parts.select(group, F.struct("__s", F.concat(F.lit("<trkseg>"), F.array_join(F.transform("p", point), ""), F.lit("</trkseg>")).alias("x")).alias("part"))
    head = '<?xml version="1.0" encoding="UTF-8"?><gpx xmlns="http://www.topografix.com/GPX/1/1" version="1.1" creator="wayfare"><trk>'
    g = parts.groupBy(group).agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return g.select(group, F.concat(F.lit(head), F.array_join(F.transform("parts", lambda s: s["x"]), ""), F.lit("</trk></gpx>")).alias("gpx"))


def read_gpx(df: DataFrame, text: str) -> DataFrame:
    """Adds pos, lat, lon: the points of each document's first route, or else of its first track, without times; documents
    without either give no rows."""
    route = F.concat(F.regexp_extract(text, r"(?s)<rte>(.*?)</rte>", 1), F.when(~F.contains(F.col(text), F.lit("<rte>")), F.regexp_extract(text, r"(?s)<trk>(.*?)</trk>", 1)).otherwise(""))
    points = F.regexp_extract_all(route, F.lit(r"<(?:rte|trk)pt\s[^>]*>"), F.lit(0))
    number = lambda name: F.nullif(F.regexp_extract("point", rf'\b{name}="([-+0-9.eE]+)"', 1), F.lit("")).cast("double")
    x = df.select("*", F.posexplode(points).alias("pos", "point"))
    return x.withColumns({"lat": number("lat"), "lon": number("lon")}).drop("point")
