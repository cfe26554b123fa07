"""Texts that trajectories are exchanged as: coordinates, GeoJSON, map-matching samples, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colours of modes on a map.
COLOURS = {"walk": "#00ff00", "bike": "#0000ff", "car": "#ff0000", "bus": "#ffff00", "train": "#ff00ff", "still": "#000000"}


def latlon(lat: Column, lon: Column) -> Column:
    """``[lat,lon]`` with six decimals."""
    return F.format_string("[%.6f,%.6f]", lat, lon)


def lonlat(lat: Column, lon: Column) -> Column:
    """``[lon,lat]`` with six decimals."""
    return F.format_string("[%.6f,%.6f]", lon, lat)


def path(trace: Column) -> Column:
    """``[[lon,lat], ...]`` of an array of structs with lat and lon."""
    return F.concat(F.lit("["), F.array_join(F.transform(trace, lambda p: lonlat(p["lat"], p["lon"])), ", "), F.lit("]"))


def point_feature(lat: Column, lon: Column, properties: Column) -> Column:
    """A GeoJSON point; ``properties`` is JSON text."""
    return F.concat(F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":'), lonlat(lat, lon), F.lit('},"properties":'), properties, F.lit("}"))


def line_feature(trace: Column, properties: Column) -> Column:
    return F.concat(F.lit('{"type":"Feature","geometry":{"type":"LineString","coordinates":'), path(trace), F.lit('},"properties":'), properties, F.lit("}"))


def collection(features: Column) -> Column:
    """A FeatureCollection of an array of features."""
    return F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(features, ","), F.lit("]}"))


_HEAD, _TAIL = '{"type":"FeatureCollection","features":[', "]}"


def merged(*collections: Column) -> Column:
    """One FeatureCollection of the features of several, taken out between its fixed head and tail; other texts, and
    collections without features, add none."""

    def inner(c: Column) -> Column:
        own = F.startswith(c, F.lit(_HEAD)) & F.endswith(c, F.lit(_TAIL))
        return F.nullif(F.when(own, F.substr(c, F.lit(len(_HEAD) + 1), F.length(c) - len(_HEAD) - len(_TAIL))), F.lit(""))

    return F.concat(F.lit(_HEAD), F.concat_ws(",", *map(inner, collections)), F.lit(_TAIL))


def sample(key: Column, t_ms: Column, lat: Column, lon: Column) -> Column:
    """A map-matching sample with a WKT point."""
    return F.format_string('{"id":"%s","time":%d,"point":"POINT (%.6f %.6f)"}', key, t_ms, lon, lat)


def share_url(json: Column) -> Column:
    """A link that shows GeoJSON in a map viewer; spaces as %20."""
    return F.concat(F.lit("http://geojson.io/#data=data:application/json,"), F.replace(F.url_encode(json), F.lit("+"), F.lit("%20")))


def colour(mode: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv]), mode)


def hex_of(red: Column, green: Column, blue: Column) -> Column:
    """A colour as ``#rrggbb``."""
    return F.format_string("#%02x%02x%02x", red, green, blue)


def plain_trace(trace: Column) -> Column:
    """An array of (t, ..., lat, lon) structs without those that equal the one before."""
    return F.filter(trace, lambda p, i: (i == 0) | ~F.get(trace, i - 1).eqNullSafe(p))


def points_document(trace: Column, properties: Column) -> Column:
    """A collection of one point feature per point of a trace; repeats in a row once."""
    return collection(F.transform(plain_trace(trace), lambda p: point_feature(p["lat"], p["lon"], properties)))


def line_document(trace: Column) -> Column:
    """A collection of one line feature; repeats in a row once; its first and last time as properties."""
    ends = F.format_string('{"timestamp-start":%d,"timestamp-end":%d}', F.get(trace, 0)["t"], F.get(trace, F.size(trace) - 1)["t"])
    return collection(F.array(line_feature(plain_trace(trace), ends)))


def document(trace: Column, form: str, properties: Column | None = None) -> Column:
    """A trace as ``points`` or ``linestring``; any other form is an error."""
    if form == "points":
        return points_document(trace, F.lit("{}") if properties is None else properties)
    if form == "linestring":
        return line_document(trace)
    raise ValueError(f"no such form: {form}")


def trip_document(trace: Column) -> Column:
    """A trip: its start marked s, its end marked e, and its line."""
    mark = lambda p, sign: collection(F.array(point_feature(p["lat"], p["lon"], F.lit('{"marker-symbol":"' + sign + '"}'))))
    return merged(mark(F.get(trace, 0), "s"), mark(F.get(trace, F.size(trace) - 1), "e"), line_document(trace))


def coloured_document(stages: Column) -> Column:
    """A trip in the colours of its modes: one line per stage of an array of (mode, trace)."""
    style = lambda s: F.format_string('{"mode":"%s","stroke":"%s"}', s["mode"], F.coalesce(colour(s["mode"]), F.lit("#808080")))
    return collection(F.transform(stages, lambda s: line_feature(plain_trace(s["trace"]), style(s))))


def json_path(trace: Column) -> Column:
    """``[[lon,lat],...]`` as a JSON array of numbers."""
    return F.to_json(F.transform(trace, lambda p: F.array(p["lon"].cast("decimal(12,6)"), p["lat"].cast("decimal(12,6)"))))


def hue_colours(n: int) -> list[str]:
    """``n`` distinct colours, spaced by the golden angle."""
    import colorsys

    return ["#%02x%02x%02x" % tuple(round(255 * c) for c in colorsys.hsv_to_rgb(k * 0.61803398875 % 1, 0.8, 0.95)) for k in range(n)]
