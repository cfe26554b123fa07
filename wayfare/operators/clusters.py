"""Density clustering of trajectories: time-ordered stops, and spatial and spatio-temporal DBSCAN."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.operators.chunked import by_key
from wayfare.operators.trajectory import inside_spans, mean_pair_speed
from wayfare.session import cut


def _km(lat: np.ndarray, lon: np.ndarray, i: int, js: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat[i]), np.radians(lat[js])
    h = np.sin((b - a) / 2) ** 2 + np.sin(np.radians(lon[js] - lon[i]) / 2) ** 2 * np.cos(a) * np.cos(b)
    return 2 * 6371.0 * np.arcsin(np.sqrt(h))


def ordered_clusters(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, ceps: float, eps: float, least: int, expand_all: bool = False) -> list[list[int]]:
    """Clusters of point indices in order of insertion.

    A point's neighbours are the points from it on, the last of the trajectory left out, up to the first beyond ``ceps``
    km, within ``eps`` km. A point with ``least`` neighbours (any point with ``expand_all``) grows a cluster through its
    neighbours' neighbours; the search goes on after the latest time reached. Clusters of ``least`` points are kept;
    ones that overlap in time, then ones whose ends lie within ``ceps`` km, are joined from the right.
    """
    n = len(t)
    memo: dict[int, list[int]] = {}

    def near(i: int) -> list[int]:
        if i not in memo:
            out, j, width = [], i, 64
            while j < n - 1:
                js = np.arange(j, min(j + width, n - 1))
                d = _km(lat, lon, i, js)
                far = np.flatnonzero(d > ceps)
                stop = far[0] if len(far) else len(js)
                out += js[:stop][d[:stop] <= eps].tolist()
                if len(far):
                    break
                j, width = j + width, width * 2
            memo[i] = out
        return memo[i]

    clusters, member, visited = [], np.zeros(n, bool), np.zeros(n, bool)
    at = 0
    while at < n and t[at] <= t[n - 1]:
        first, reached = at, t[at]
        seeds = near(first)
        visited[first] = True
        if len(seeds) >= least or expand_all:
            cluster, seeds, seen = [first], list(seeds), set(seeds)
            member[first] = True
            for c in seeds:  # grows while it is walked
                reached = max(reached, t[c])
                if not visited[c]:
                    visited[c] = True
                    more = near(c)
                    if len(more) >= least or expand_all:
                        fresh = [m for m in more if m not in seen]
                        seeds += fresh
                        seen.update(fresh)
                if not member[c]:
                    member[c] = True
                    cluster.append(c)
            clusters.append(cluster)
        if reached >= t[n - 1]:
            break
        at = int(np.searchsorted(t, reached, side="right"))
    clusters = [c for c in clusters if len(c) >= least]

    def joined(parts: list[list[int]], touch) -> list[list[int]]:
        out: list[list[int]] = []
        for c in reversed(parts):
            if out and touch(c, out[0]):
                out[0] = c + out[0]
            else:
                out.insert(0, c)
        return out

    clusters = joined(clusters, lambda a, b: t[a[-1]] > t[b[0]])
    return joined(clusters, lambda a, b: _km(lat, lon, a[-1], np.array([b[0]]))[0] < ceps)


def stop_points(df: DataFrame, ceps: float, eps: float, least: int, expand_all: bool = False) -> DataFrame:
    """(track, stop, pos, id, t, lat, lon): the points of each stop cluster in order of insertion. One track, a day of
    one device, is clustered at a time."""

    names = ["track", "stop", "pos", "id", "t", "lat", "lon"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in by_key(batches, ["track"]):
            parts = ordered_clusters(*(x.column(c).to_numpy() for c in ("t", "lat", "lon")), ceps, eps, least, expand_all)
            if parts:
                y = x.take(pa.array(np.concatenate(parts), pa.int64()))
                y = y.append_column("stop", pa.array(np.repeat(np.arange(len(parts)), [len(c) for c in parts]), pa.int64()))
                yield from y.append_column("pos", pa.array(np.concatenate([np.arange(len(c)) for c in parts]), pa.int64())).select(names).combine_chunks().to_batches()

    kind = dict(df.dtypes)["track"]
    rows = df.select("track", "id", "t", "lat", "lon").dropna().repartition("track").sortWithinPartitions("track", "t", "id")
    return rows.mapInArrow(run, f"track {kind}, stop long, pos long, id long, t long, lat double, lon double")


def trips_between_stops(df: DataFrame, stops: DataFrame, least_kmh: float = 4.0) -> DataFrame:
    """(track, trip, start_id, end_id, n, kmh): from the last point of a stop to the first of the next, with the points
    between, if their mean pair speed is above ``least_kmh``; a track without stops is one trip of its whole."""
    points = cut(trip_points(df, cut(stops)))
    speed = mean_pair_speed(points, ["track", "trip"])
    q = F.struct("t", "id")
    shape = points.groupBy("track", "trip").agg(F.min(q).alias("a"), F.max(q).alias("b"), F.count(F.lit(1)).alias("n"))
    return shape.join(speed, ["track", "trip"]).where(F.col("kmh") > least_kmh).select("track", "trip", F.col("a.id").alias("start_id"), F.col("b.id").alias("end_id"), "n", "kmh")


def trip_points(df: DataFrame, stops: DataFrame) -> DataFrame:
    """(track, trip, id, t, lat, lon): the points of every leg between two successive stops, its ends included, and of
    tracks without a stop. ``stops`` is read several times; give a written table."""
    p = F.struct("pos", "t", "id", "lat", "lon")
    ends = stops.groupBy("track", "stop").agg(F.min(p).alias("a"), F.max(p).alias("b"))
    w = Window.partitionBy("track").orderBy("stop")
    legs = ends.select("track", F.col("stop").alias("trip"), F.col("b").alias("begin"), F.lead("a").over(w).alias("end")).where("end is not null")
    spans = legs.select("track", "trip", F.col("begin.t").alias("a"), F.col("end.t").alias("b"))
    inner = inside_spans(df.select("track", "id", "t", "lat", "lon"), spans, ["track"]).select("track", "trip", "id", "t", "lat", "lon")
    edge = legs.select("track", "trip", F.inline(F.array(F.struct("begin.id", "begin.t", "begin.lat", "begin.lon"), F.struct("end.id", "end.t", "end.lat", "end.lon"))))
    whole = df.join(stops.select("track").distinct(), "track", "left_anti").select("track", F.lit(0).cast("long").alias("trip"), "id", "t", "lat", "lon")
    return inner.unionByName(edge).unionByName(whole)


def _any_near(t, lat, lon, a: np.ndarray, b: np.ndarray, eps_km: float, within_us: int | None) -> bool:
    """Whether any point of ``a`` is a neighbour of any of ``b``; looked at in tiles, so that dense cells end early."""
    for i in range(0, len(a), 64):
        for j in range(0, len(b), 1024):
            if _near(t, lat, lon, a[i : i + 64], b[j : j + 1024], eps_km, within_us).any():
                return True
    return False


def _near(t, lat, lon, a: np.ndarray, b: np.ndarray, eps_km: float, within_us: int | None) -> np.ndarray:
    """The matrix of neighbours between points ``a`` and ``b``; coordinates in radians."""
    h = np.sin((lat[b] - lat[a][:, None]) / 2) ** 2 + np.sin((lon[b] - lon[a][:, None]) / 2) ** 2 * np.cos(lat[a])[:, None] * np.cos(lat[b])
    close = 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(h, 1.0))) <= eps_km
    return close if within_us is None else close & (np.abs(t[b] - t[a][:, None]) <= within_us)


def dbscan(t: np.ndarray, lat_deg: np.ndarray, lon_deg: np.ndarray, eps_km: float, least: int, within_us: int | None = None) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """(component of each core point or -1, core flags, border points with the components beside them).

    Points are put into cells so small that all points of one cell are neighbours: a cell of ``least`` points is all
    core without a look at any pair, and the core points of a cell are one component. Only sparse cells are counted
    point by point against the cells in reach, and two cells are linked by the first pair found. No pairs are kept.
    """
    n, lat, lon = len(t), np.radians(lat_deg), np.radians(lon_deg)
    side = np.degrees(eps_km / 6371.0) / 2**0.5 * 0.999
    # The cells of a row are as wide as a cell may be at the row's end nearest the equator.
    row = np.floor(lat_deg / side).astype(np.int64)
    wide = lambda r: side / np.maximum(np.cos(np.radians(np.minimum(np.abs(r), np.abs(r + 1)) * side)), 1e-3)
    col = np.floor(lon_deg / wide(row)).astype(np.int64)
    age = np.zeros(n, np.int64) if within_us is None else t // max(1, within_us)
    cells: dict[tuple[int, int, int], list[int]] = {}
    for k, c in enumerate(zip(row.tolist(), col.tolist(), age.tolist())):
        cells.setdefault(c, []).append(k)
    cells = {c: np.array(v) for c, v in cells.items()}

    def around(c: tuple[int, int, int]) -> list[tuple[int, int, int]]:
        r, k, a = c
        out = []
        for r2 in range(r - 2, r + 3):
            # Columns of another row that the reach of this cell touches.
            w, w2 = float(wide(np.int64(r))), float(wide(np.int64(r2)))
            far = np.degrees(eps_km / 6371.0) / max(np.cos(np.radians(min(89.9, (max(abs(r), abs(r2)) + 1) * side))), 1e-3)
            for k2 in range(int(np.floor((k * w - far) / w2)), int(np.floor(((k + 1) * w + far) / w2)) + 1):
                out += [x for a2 in ((a,) if within_us is None else (a - 1, a, a + 1)) if (x := (r2, k2, a2)) in cells]
        return out

    core, beside = np.zeros(n, bool), {c: around(c) for c in cells}
    for c, mine in cells.items():
        if len(mine) >= least:
            core[mine] = True
            continue
        theirs = np.concatenate([cells[x] for x in beside[c]])
        count = sum(_near(t, lat, lon, mine, theirs[j : j + 65536], eps_km, within_us).sum(axis=1) for j in range(0, len(theirs), 65536))
        core[mine] = count >= least
    parent = {c: c for c in cells}

    def root(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    cores = {c: v[core[v]] for c, v in cells.items()}
    for c, mine in cores.items():
        for x in beside[c]:
            if x > c and len(mine) and len(cores[x]) and root(x) != root(c) and _any_near(t, lat, lon, mine, cores[x], eps_km, within_us):
                parent[root(x)] = root(c)
    number = {c: k for k, c in enumerate(cells)}
    label = np.full(n, -1, np.int64)
    for c, mine in cores.items():
        label[mine] = number[root(c)]
    border = []
    for c, mine in cells.items():
        loose = mine[~core[mine]]
        if len(loose):
            near = {}
            for x in beside[c]:
                if len(cores[x]):
                    hit = np.zeros(len(loose), bool)
                    for j in range(0, len(cores[x]), 65536):
                        hit |= _near(t, lat, lon, loose, cores[x][j : j + 65536], eps_km, within_us).any(axis=1)
                    for k in loose[hit].tolist():
                        near.setdefault(k, set()).add(number[root(x)])
            border += [(k, np.array(sorted(v))) for k, v in near.items()]
    return label, core, border


def density_clusters(df: DataFrame, eps_km: float, least: int, within_s: int | None = None) -> DataFrame:
    """(track, id, cluster): DBSCAN per track by distance and, with ``within_s``, time; ``cluster`` is the smallest id
    among the cluster's core points, null for noise. A border point joins the neighbouring cluster of the smallest id.
    Points with a null position or time are noise. One track, a day of one device, is clustered at a time; see ``dbscan``.
    """
    kind = dict(df.dtypes)["track"]
    within_us = None if within_s is None else within_s * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in by_key(batches, ["track"]):
            good = np.ones(len(x), bool)
            for c in ("t", "lat", "lon"):
                good &= np.asarray(x.column(c).is_valid())
            ids = x.column("id").to_numpy()[good]
            label, core, border = dbscan(*(x.column(c).filter(pa.array(good)).to_numpy() for c in ("t", "lat", "lon")), eps_km, least, within_us)
            least_id: dict[int, int] = {}
            for k, i in zip(label[core].tolist(), ids[core].tolist()):
                least_id[k] = min(i, least_id.get(k, i))
            found = [least_id.get(k) for k in label.tolist()]
            for k, near in border:
                found[k] = min(least_id[c] for c in near.tolist())
            every: list[int | None] = [None] * len(x)
            for k, v in zip(np.flatnonzero(good).tolist(), found):
                every[k] = v
            y = x.select(["track", "id"]).append_column("cluster", pa.array(every, pa.int64()))
            yield from y.combine_chunks().to_batches()

    rows = df.select("track", "id", "t", "lat", "lon").repartition("track").sortWithinPartitions("track")
    return rows.mapInArrow(run, f"track {kind}, id long, cluster long")
