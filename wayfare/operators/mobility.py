"""Stops and trips from location pings, by penalised changepoint segmentation per device.

Fixes are filtered first (accuracy, sense, single fixes no vehicle could reach and leave), and silences break each
device's sequence. The displacement over the least duration of a stop, that is the mean speed kept up for so long,
is then segmented at changepoints: a segment at rest holds the fixes whose displacement stays within the diameter and,
as every changepoint costs ``PENALTY``, the shorter stretches between them. Only segments at rest are searched, and
what is a stop in them is decided by the definition: going from left to right, a longest stretch of fixes that are all
within the diameter of each other and last long enough. The penalty decides how the search is divided, never its result.

A stretch is grown by the convex hull of its fixes: a fix inside it can be no further from any other than the corners
are, so a device at rest costs a few operations on arrays per thousand fixes. Devices are cut into stretches of time
that are worked on in parallel, each from a fresh start; a pass over one small row per stretch joins stops across the
cuts. A stretch whose fresh start proves wrong, because a stop that reaches into it ends differently, is done again.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from wayfare.operators.chunked import by_key, chunk_of
from wayfare.session import cut

#: Cost of a changepoint, in fixes: stretches of up to twice as many between segments at rest are searched with them.
PENALTY = 2
EARTH_M = 6_371_000.0
#: Width of the stretches of time that a device is cut into.
STRETCH_US = 86_400_000_000
#: Metres by which a fix must lie inside the hull to be left out of it.
_MARGIN_M = 1e-4


def _far_m(lat: np.ndarray, lon: np.ndarray, lat1: np.ndarray, lon1: np.ndarray) -> np.ndarray:
    """Great-circle metres between points in radians."""
    h = np.sin((lat - lat1) / 2) ** 2 + np.cos(lat) * np.cos(lat1) * np.sin((lon - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def _plane(lat: np.ndarray, lon: np.ndarray, lat0: float, lon0: float) -> tuple[np.ndarray, np.ndarray]:
    """Metres on the plane that touches the globe at a point; great circles become straight lines."""
    c = np.sin(lat0) * np.sin(lat) + np.cos(lat0) * np.cos(lat) * np.cos(lon - lon0)
    x = np.cos(lat) * np.sin(lon - lon0) / c
    y = (np.cos(lat0) * np.sin(lat) - np.sin(lat0) * np.cos(lat) * np.cos(lon - lon0)) / c
    return EARTH_M * x, EARTH_M * y


def _hull(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Positions of the corners of the convex hull, counter-clockwise."""
    order = np.lexsort((y, x)).tolist()
    px, py = x.tolist(), y.tolist()

    def half(points: list[int]) -> list[int]:
        out: list[int] = []
        for p in points:
            while len(out) > 1 and (px[out[-1]] - px[out[-2]]) * (py[p] - py[out[-2]]) - (py[out[-1]] - py[out[-2]]) * (px[p] - px[out[-2]]) <= 0:
                out.pop()
            out.append(p)
        return out

    return half(order)[:-1] + half(order[::-1])[:-1] if len(order) > 1 else order


def reach(lat: np.ndarray, lon: np.ndarray, start: int, n: int, diameter_m: float) -> tuple[int, list[int], list[int]]:
    """(last, corners, extremes): the last index below ``n`` up to which all fixes from ``start`` on lie within the
    diameter of each other; fixes whose hull holds all of these; and, in order, every fix that lay outside the hull of
    those before it (some others may be among them). Coordinates in radians."""
    corners, extremes = [start], [start]
    at, width = start + 1, 16
    lat0, lon0 = lat[start], lon[start]
    while at < n:
        to = min(n, at + width)
        width = min(2 * width, 4096)
        c = np.array(corners)
        d = _far_m(lat[c][:, None], lon[c][:, None], lat[at:to], lon[at:to])
        bad = (d > diameter_m).any(axis=0)
        end = at + int(bad.argmax()) if bad.any() else to
        if end > at:
            fresh = (d[:, : end - at] > 0).all(axis=0)
            if len(corners) > 2:
                cx, cy = _plane(lat[c], lon[c], lat0, lon0)
                k = _hull(cx, cy)
                if len(k) > 2:
                    cx, cy = cx[k][:, None], cy[k][:, None]
                    ex, ey = np.roll(cx, -1, axis=0) - cx, np.roll(cy, -1, axis=0) - cy
                    px, py = _plane(lat[at:end], lon[at:end], lat0, lon0)
                    fresh &= ((ex * (py - cy) - ey * (px - cx)) / np.hypot(ex, ey) < _MARGIN_M).any(axis=0)
            for p in (at + np.flatnonzero(fresh)).tolist():
                if p >= end:
                    break
                far = np.flatnonzero(_far_m(lat[p + 1 : end], lon[p + 1 : end], lat[p], lon[p]) > diameter_m)
                if len(far):
                    end = p + 1 + int(far[0])
                corners.append(p)
                extremes.append(p)
        if end < to:
            return end - 1, corners, extremes
        if len(corners) > 12:
            c = np.array(corners)
            corners = sorted(c[_hull(*_plane(lat[c], lon[c], lat0, lon0))].tolist())
        at = to
    return n - 1, corners, extremes


def segments_at_rest(displaced: np.ndarray, diameter_m: float, penalty: int = PENALTY) -> list[tuple[int, int]]:
    """Index ranges, ends included, of the segments at rest of the least cost: each changepoint costs ``penalty``, each
    moving fix in a segment at rest 1, and no fix that may begin a stop (displaced by at most the diameter, not NaN) may
    be in a moving segment. So two such fixes are in one segment where at most twice the penalty lie between them."""
    still = np.flatnonzero(displaced <= diameter_m)
    if not len(still):
        return []
    parts = np.flatnonzero(np.diff(still) - 1 > 2 * penalty)
    return list(zip(still[np.concatenate(([0], parts + 1))].tolist(), still[np.concatenate((parts, [len(still) - 1]))].tolist()))


def longest_stops(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, begin: int, end: int, diameter_m: float, least_us: int, penalty: int = PENALTY) -> tuple[list[tuple[int, int]], int]:
    """(stops, next): the stops among fixes ``begin`` to below ``end``, between which nothing breaks, as index pairs with
    both ends included, and the first fix from which on another stop could begin if fixes were to follow."""
    stops, i = [], begin
    after = np.searchsorted(t[begin:end], t[begin:end] + least_us, side="left") + begin
    fits = after < end
    far = np.full(end - begin, np.nan)
    k = np.flatnonzero(fits)
    far[k] = _far_m(lat[begin + k], lon[begin + k], lat[after[k]], lon[after[k]])
    for a, b in segments_at_rest(far, diameter_m, penalty):
        i = max(i, begin + a)
        while i <= begin + b:
            if not far[i - begin] <= diameter_m:
                i += 1
                continue
            last, _, _ = reach(lat, lon, i, end, diameter_m)
            if t[last] - t[i] >= least_us:
                stops.append((i, last))
                i = last + 1
            else:
                # The fix that ends the stretch is too far from this one and so ends every stretch up to it.
                i += int(np.flatnonzero(_far_m(lat[i : last + 1], lon[i : last + 1], lat[last + 1], lon[last + 1]) > diameter_m)[-1]) + 1
    return stops, max(i, stops[-1][1] + 1 if stops else begin)


def usable_pings(
    df: DataFrame, device: str, at_us: str, row_id: str, accuracy: str, lat: Column, lon: Column, most_accuracy_m: float = 200.0
) -> DataFrame:
    """(device, at, id, lat, lon): fixes with an instant, an accuracy above 0 and at most ``most_accuracy_m`` and a
    sensible position; of several at one instant of a device the one with the smallest id."""
    ok = (
        F.col(device).isNotNull() & F.col(at_us).isNotNull() & (F.col(accuracy) > 0) & (F.col(accuracy) <= most_accuracy_m)
        & lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    )
    rows = df.where(ok).select(F.col(device).alias("device"), F.col(at_us).alias("at"), F.col(row_id).alias("id"), lat.alias("lat"), lon.alias("lon"))
    best = F.min(F.struct("id", "lat", "lon"))
    return rows.groupBy("device", "at").agg(best.alias("best")).select("device", "at", "best.id", "best.lat", "best.lon")


def _summary(t, ids, lat, lon, halo, p0: int, diameter_m: float, least_us: int, silence_us: int, most_kmh: float) -> dict | None:
    """What one stretch of a device's fixes, in order, says of itself: its stops from fix ``p0`` on, and what is needed to
    join it to the stretches beside it. ``halo`` marks the fixes before and after it; coordinates in radians."""
    own = ~halo
    with np.errstate(divide="ignore", invalid="ignore"):
        kmh = _far_m(lat[1:], lon[1:], lat[:-1], lon[:-1]) * 3600.0 / 1000.0 * 1e6 / (t[1:] - t[:-1])
    fast = np.concatenate(([False], kmh > most_kmh, [False]))
    keep = own & ~(fast[:-1] & fast[1:])
    t, ids, lat, lon = t[keep], ids[keep], lat[keep], lon[keep]
    n = len(t)
    if not n:
        return None
    hop = np.concatenate(([0.0], _far_m(lat[1:], lon[1:], lat[:-1], lon[:-1])))
    silent = np.concatenate(([False], np.diff(t) > silence_us))
    breaks = silent | (hop > diameter_m)
    cum = np.cumsum(np.where(silent, 0.0, hop))
    fix = lambda k: (int(k), int(t[k]), int(ids[k]), float(cum[k]))
    place = lambda k: (float(lat[k]), float(lon[k]))
    edges = np.concatenate(([0], np.flatnonzero(breaks), [n])).tolist()
    stops, open_ = [], None
    for a, b in zip(edges, edges[1:]):
        if b <= p0 or (b < n and t[b - 1] - t[a] < least_us):
            continue
        found, i = longest_stops(t, lat, lon, max(a, p0), b, diameter_m, least_us)
        if b == n and found and found[-1][1] == n - 1:
            s = found.pop()[0]
            open_ = ("stop", fix(s), [place(k) for k in reach(lat, lon, s, n, diameter_m)[1]])
        elif b == n:
            back, _, extremes = reach(lat[i:][::-1], lon[i:][::-1], 0, n - i, diameter_m) if i < n else (-1, [], [])
            if back >= 0:
                recs = [(n - 1 - k, place(n - 1 - k), fix(n - k) if k else None) for k in extremes if k <= back]
                open_ = ("tail", fix(n - 1 - back), recs[::-1])
        stops += [(fix(x), fix(y)) for x, y in found]
    e0, _, extremes = reach(lat, lon, 0, edges[1], diameter_m)
    return {
        "p0": p0, "n": n, "first": (fix(0), place(0)), "last": (fix(n - 1), place(n - 1)), "stops": stops, "open": open_,
        "silences": [(fix(k - 1), fix(k)) for k in np.flatnonzero(silent).tolist()],
        "head": (fix(e0), fix(e0 + 1) if e0 + 1 < n else None, [(fix(k), place(k), fix(k - 1) if k else None) for k in extremes if k <= e0]),
    }


def _beyond(places: list[tuple[float, float]], one: tuple[float, float], diameter_m: float) -> np.ndarray:
    p = np.array(places)
    return np.flatnonzero(_far_m(p[:, 0], p[:, 1], *one) > diameter_m)


class _Joined:
    """Joins the stretches of one device, given in order, and lists its stops and trips."""

    def __init__(self, diameter_m: float, least_us: int, silence_us: int):
        self.diameter_m, self.least_us, self.silence_us = diameter_m, least_us, silence_us
        self.stops: list[tuple] = []
        self.bounds: list[tuple] = []  # first and last fix of every session
        self.again: list[tuple[int, int]] = []  # stretches to be done again, and from which fix on
        self.open: tuple | None = None
        self.last: tuple | None = None
        self.base, self.metres = 0, 0.0

    def _at(self, fix: tuple | None) -> tuple | None:
        """A fix of the present stretch, counted over the whole device."""
        return fix and (fix[0] + self.base, fix[1], fix[2], fix[3] + self.metres)

    def _close(self) -> None:
        if self.open and self.open[0] == "stop":
            self.stops.append((self.open[1], self.last[0]))
        self.open = None

    def add(self, chunk: int, s: dict) -> None:
        first, place = s["first"]
        p0, goes_on = 0, self.last is not None
        if goes_on:
            silent = first[1] - self.last[0][1] > self.silence_us
            hop = float(_far_m(*place, *self.last[1]))
            self.metres = self.last[0][3] + (0.0 if silent else hop)
            if silent:
                self.bounds[-1][1] = self.last[0]
            if silent or hop > self.diameter_m:
                self._close()
            if silent:
                self.bounds.append([self._at(first), None])
        else:
            self.bounds.append([self._at(first), None])
        p0 = self._enter(s) if self.open else 0
        if p0 < s["n"]:
            now = s["open"]
            if p0 < s["p0"] or any(a[0] < p0 <= b[0] for a, b in s["stops"]) or (now and now[0] == "stop" and now[1][0] < p0):
                self.again.append((chunk, p0))
            self.stops += [(self._at(a), self._at(b)) for a, b in s["stops"] if a[0] >= p0]
            if now and now[0] == "stop":
                self.open = ("stop", self._at(now[1]), list(now[2]))
            elif now:
                start = now[1] if now[1][0] >= p0 else self.begin
                self.open = ("tail", self._at(start), [(at, self._at(after)) for k, at, after in now[2] if k >= p0])
            else:
                self.open = None
        for before, after in s["silences"]:
            self.bounds[-1][1] = self._at(before)
            self.bounds.append([self._at(after), None])
        self.last = (self._at(s["last"][0]), s["last"][1])
        self.base += s["n"]

    def _enter(self, s: dict) -> int:
        """Carry what is open into a stretch; the first of its fixes that is not taken, ``n`` if all are."""
        e0, past, records = s["head"]
        kind, start, held = self.open
        if kind == "tail":
            held = [(at, after or self._at(s["first"][0])) for at, after in held]
        while True:
            places = held if kind == "stop" else [at for at, _ in held]
            blocked = next(((r, k) for r in records if len(k := _beyond(places, r[1], self.diameter_m))), None)
            if blocked is None and e0[0] == s["n"] - 1:
                # The whole stretch is taken.
                places = places + [r[1] for r in records]
                if kind == "stop" or s["last"][0][1] - start[1] >= self.least_us:
                    p = np.array(places)
                    self.open = ("stop", start, p[_hull(*_plane(p[:, 0], p[:, 1], *p[0]))].tolist())
                else:
                    own = s["open"]
                    self.open = ("tail", start, held + ([(at, self._at(after)) for _, at, after in own[2]] if own and own[0] == "tail" else []))
                return s["n"]
            if blocked is None:
                end, self.begin, after = self._at(e0), past, e0[0] + 1
            else:
                (fix, _, before), _ = blocked
                end, self.begin, after = self._at(before) or self.last[0], fix, fix[0]
            if kind == "stop" or end[1] - start[1] >= self.least_us:
                self.stops.append((start, end))
                self.open = None
                return after
            if blocked is None:
                self.open = None
                return 0
            # A start up to the last fix that is too far off cannot pass the fix in the way.
            held, start = held[blocked[1][-1] + 1 :], held[blocked[1][-1]][1]
            if not held:
                self.open = None
                return 0

    def result(self) -> Iterator[tuple]:
        """(kind, first fix, last fix) in order; a fix is (number, at, id, metres so far)."""
        self._close()
        if self.last is not None:
            self.bounds[-1][1] = self.last[0]
        k = 0
        for lo, hi in self.bounds:
            at, count = lo, lo[0] - 1  # where the trip begins, and the last fix before its own
            while k < len(self.stops) and self.stops[k][0][0] <= hi[0]:
                a, b = self.stops[k]
                if a[0] > count + 1:
                    yield "trip", at, a
                yield "stop", a, b
                at, count, k = b, b[0], k + 1
            if hi[0] > count:
                yield "trip", at, hi


def stops_and_trips(
    pings: DataFrame,
    diameter_m: float = 100.0,
    least_us: int = 600_000_000,
    silence_us: int = 3_600_000_000,
    most_kmh: float = 300.0,
    stretch_us: int = STRETCH_US,
) -> DataFrame:
    """(device, kind, first_id, last_id, start_us, end_us, duration_s, distance_m) of ``usable_pings``.

    A stop is a stretch of successive fixes, all within ``diameter_m`` of each other, of at least ``least_us``; where two
    such stretches overlap the earlier is kept whole, so from left to right each stop is as long as can be. A trip is the
    rest between two stops, silences or ends, from the stop before to the stop after, and holds at least one fix in no
    stop. No segment crosses a silence of more than ``silence_us``. Distances add up the hops between successive fixes,
    silences left out. An empty input gives no rows. A device without a name is left out.

    One task holds one stretch of ``stretch_us`` of one device at a time, then one small row per stretch.
    """
    rows = pings.withColumn("chunk", chunk_of(F.col("at"), stretch_us))
    # The fixes beside each stretch: of every stretch the first and last, handed to its neighbours.
    point = F.struct("at", "id", "lat", "lon")
    ends = rows.groupBy("device", "chunk").agg(F.min(point).alias("head"), F.max(point).alias("tail"))
    along = Window.partitionBy("device").orderBy("chunk")
    beside = ends.select("device", "chunk", F.lag("tail").over(along).alias("before"), F.lead("head").over(along).alias("after"))
    beside = beside.select("device", "chunk", F.inline(F.filter(F.array("before", "after"), lambda x: x.isNotNull())))
    every = rows.select("device", "chunk", "at", "id", "lat", "lon", F.lit(False).alias("halo")).unionByName(beside.select("device", "chunk", "at", "id", "lat", "lon", F.lit(True).alias("halo")))
    kind, name_type = dict(pings.dtypes)["device"], to_arrow_type(pings.schema["device"].dataType)
    options = (diameter_m, least_us, silence_us, most_kmh)

    def summaries(fixes: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[list] = [[], [], []]
            for (device, chunk), x in by_key(batches, ["device", "chunk"]):
                t, ids, lat, lon, halo, p0 = (x.column(c).to_numpy() for c in ("at", "id", "lat", "lon", "halo", "p0"))
                if (s := _summary(t, ids, np.radians(lat), np.radians(lon), halo.astype(bool), int(p0[0]), *options)) is not None:
                    for column, v in zip(out, (device, chunk, pickle.dumps(s))):
                        column.append(v)
                if len(out[0]) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], name_type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["device", "chunk", "summary"])
                    out = [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], name_type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["device", "chunk", "summary"])

        sorted_ = fixes.repartition("device", "chunk").sortWithinPartitions("device", "chunk", "at")
        return sorted_.mapInArrow(run, f"device {kind}, chunk long, summary binary")

    schema = f"device {kind}, kind string, first_id long, last_id long, start_us long, end_us long, distance_m double, chunk long, p0 int"
    names = [f.split()[0] for f in schema.split(", ")]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [name_type, pa.string(), *[pa.int64()] * 4, pa.float64(), pa.int64(), pa.int32()]
        for (device,), x in by_key(batches, ["device"]):
            one = _Joined(diameter_m, least_us, silence_us)
            for chunk, s in zip(x.column("chunk").to_pylist(), x.column("summary")):
                one.add(chunk, pickle.loads(s.as_py()))
            if one.again:
                found = [(device, "again", None, None, None, None, None, c, p) for c, p in one.again]
            else:
                found = [(device, how, a[2], b[2], a[1], b[1], b[3] - a[3], None, None) for how, a, b in one.result()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    known = cut(summaries(every.withColumn("p0", F.lit(0))))
    while True:
        found = cut(known.repartition("device").sortWithinPartitions("device", "chunk").mapInArrow(join, schema))
        again = found.where("kind = 'again'").select("device", "chunk", "p0")
        if not again.limit(1).count():
            break
        redone = summaries(every.join(again, ["device", "chunk"]))
        known = cut(known.join(again, ["device", "chunk"], "left_anti").unionByName(redone))
    return found.select("device", "kind", "first_id", "last_id", "start_us", "end_us", ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_s"), "distance_m")
