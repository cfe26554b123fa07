"""Interfaces of external services, with local stand-ins that need no network."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions import encodings
from wayfare.functions.geo import haversine_km

TRACE = ["track", "t", "lat", "lon"]


@dataclass(frozen=True)
class Service:
    """Where an external service is, and how it may be asked."""

    address: str = ""
    key: str = ""
    vehicle: str = "car"
    seconds_between: float = 1.0
    timeout_s: float = 10.0


class MapMatcher(Protocol):
    def match(self, traces: DataFrame) -> DataFrame:
        """(track, t, lat, lon) moved onto the network, as many columns as given."""


class Identity:
    """Leaves traces as they are."""

    def match(self, traces: DataFrame) -> DataFrame:
        return traces


class FirstAndLast:
    """What a transit router is asked for: a trace's first and last point."""

    def match(self, traces: DataFrame) -> DataFrame:
        p = F.struct("t", "lat", "lon")
        g = traces.groupBy("track").agg(F.min(p).alias("a"), F.max(p).alias("b"))
        return g.select("track", F.inline(F.array("a", "b")))


class Remote:
    """A matcher behind a network. ``ask`` gets the service and one track's points in order of time as (t, lat, lon) and
    returns matched points, or None if it fails; then the track stays as it is. ``ask`` holds the protocol (HTTP with a
    GPX body, a socket with JSON samples) and whatever client it needs, so none is needed here; tests pass a function.
    One track is sent at a time, of which only ``ends`` (the first and last point) for transit routers."""

    def __init__(self, service: Service, ask: Callable[[Service, list[tuple[int, float, float]]], list[tuple[int, float, float]] | None], ends: bool = False):
        self.service, self.ask, self.ends = service, ask, ends

    def match(self, traces: DataFrame) -> DataFrame:
        service, ask, ends = self.service, self.ask, self.ends

        def run(x: pd.DataFrame) -> pd.DataFrame:
            points = list(x.sort_values("t")[TRACE[1:]].itertuples(index=False, name=None))
            try:
                found = ask(service, [points[0], points[-1]] if ends and len(points) > 1 else points)
            except OSError:
                found = None
            y = pd.DataFrame(points if found is None else found, columns=TRACE[1:])
            return y.assign(track=x.track.iloc[0])[TRACE]

        kind = dict(traces.dtypes)["track"]
        return traces.select(*TRACE).groupBy("track").applyInPandas(run, f"track {kind}, t long, lat double, lon double")


class SnapToRoads:
    """Moves each point to the nearest point of a road network (lat, lon) within ``radius_km``, else leaves it. Points
    and road points meet on grid cells."""

    def __init__(self, roads: DataFrame, radius_km: float = 0.05):
        self.roads, self.radius_km = roads, radius_km

    def match(self, traces: DataFrame) -> DataFrame:
        from wayfare.sources.places import nearby

        x = traces.select(*TRACE).withColumn("id", F.xxhash64(*TRACE))
        roads = self.roads.select(F.xxhash64("lat", "lon").alias("poi_id"), F.lit("").alias("label"), "lat", "lon").dropDuplicates(["poi_id"])
        best = nearby(x.select("id", "lat", "lon").distinct(), roads, self.radius_km, 1).select("id", "poi_id")
        at = best.join(roads.select("poi_id", F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), "poi_id")
        return x.join(at, "id", "left").select("track", "t", F.coalesce("lat2", "lat").alias("lat"), F.coalesce("lon2", "lon").alias("lon"))


def request_body(trace: Column, key: Column) -> Column:
    """The samples of a track (t, lat, lon) as the JSON array that a socket matcher is sent."""
    one = lambda p: encodings.sample(key, (p["t"] / 1000).cast("long"), p["lat"], p["lon"])
    return F.concat(F.lit("["), F.array_join(F.transform(trace, one), ","), F.lit("]"))


def moved_km(before: DataFrame, after: DataFrame) -> DataFrame:
    """(track, km): how far a matcher moved the points of each track on average, by time."""
    b = after.select("track", "t", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return before.join(b, ["track", "t"]).groupBy("track").agg(F.avg(haversine_km("lat", "lon", "lat2", "lon2")).alias("km"))


def match_by_mode(traces: DataFrame, mode: str, roads: MapMatcher, transit: MapMatcher, rail: tuple[str, ...] = ("train",)) -> DataFrame:
    """Traces of rail modes through the transit matcher, the rest through the road matcher."""
    on_rail = F.coalesce(F.col(mode).isin(*rail), F.lit(False))
    return roads.match(traces.where(~on_rail).select(*TRACE)).unionByName(transit.match(traces.where(on_rail).select(*TRACE)))
