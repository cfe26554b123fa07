"""Trips, stops and stages against folds written from their descriptions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.operators import clusters, stages, trajectory, trips
from wayfare.settings import Study

T = "track string, id long, t long, lat double, lon double"
S = 1_000_000


def _km(a, b):
    x, y = np.radians(a), np.radians(b)
    h = np.sin((y[0] - x[0]) / 2) ** 2 + np.cos(x[0]) * np.cos(y[0]) * np.sin((y[1] - x[1]) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(h))


def _golden_clusters(points, ceps, eps, least, expand_all):
    """The time-ordered clustering, point by point: (t, (lat, lon)) in order of time."""
    n = len(points)

    def near(i):
        out = []
        for j in range(i, n - 1):
            d = _km(points[i][1], points[j][1])
            if d > ceps:
                break
            if d <= eps:
                out.append(j)
        return out

    found, visited, member = [], set(), set()
    reached = points[0][0] - 86_400 * S
    while reached < points[-1][0]:
        p = next(i for i in range(n) if points[i][0] > reached)
        seeds = near(p)
        reached = points[p][0]
        visited.add(p)
        if len(seeds) >= least or expand_all:
            cluster = [p]
            member.add(p)
            k = 0
            while k < len(seeds):
                c = seeds[k]
                reached = max(reached, points[c][0])
                if c not in visited:
                    visited.add(c)
                    more = near(c)
                    if len(more) >= least or expand_all:
                        seeds += [m for m in more if m not in seeds]
                if c not in member:
                    member.add(c)
                    cluster.append(c)
                k += 1
            found.append(cluster)
    found = [c for c in found if len(c) >= least]
    for touch in (lambda a, b: points[a[-1]][0] > points[b[0]][0], lambda a, b: _km(points[a[-1]][1], points[b[0]][1]) < ceps):
        out = []
        for c in reversed(found):
            out = [c + out[0], *out[1:]] if out and touch(c, out[0]) else [c, *out]
        found = out
    return found


@pytest.mark.parametrize("expand_all", [False, True])
def test_ordered_clusters_against_a_golden_fold(expand_all):
    rng = random.Random(1)
    for _ in range(60):
        lat, lon, t, points = 45.0, 11.0, 0, []
        for _ in range(rng.randint(2, 60)):
            t += rng.choice([0, 30, 60]) * S if points else 0
            if rng.random() < 0.3:
                lat, lon = lat + rng.choice([-1, 1, 2]) * 1e-3, lon + rng.choice([-1, 0, 1]) * 1e-3
            points.append((t, (lat + rng.uniform(-3e-4, 3e-4), lon)))
        ts, la, lo = np.array([p[0] for p in points]), np.array([p[1][0] for p in points]), np.array([p[1][1] for p in points])
        assert clusters.ordered_clusters(ts, la, lo, 0.3, 0.1, 4, expand_all) == _golden_clusters(points, 0.3, 0.1, 4, expand_all)


def _walk(rng, track, start, legs):
    """Rests and ways of a device: (track, id, t, lat, lon)."""
    rows, t, lat = [], start, 45.0
    for k in range(legs):
        for _ in range(15):
            t += 60 * S
            rows.append((track, t, lat + rng.uniform(-2e-4, 2e-4), 11.0))
        for _ in range(10):
            t += 60 * S
            lat += 0.004
            rows.append((track, t, lat, 11.0))
    return rows


def test_extract_trips(spark):
    rng = random.Random(2)
    rows = _walk(rng, "a/1", 10**15, 4) + [("b/1", 10**15 + k * 60 * S, 45.0, 11.0) for k in range(30)]
    rows = [(u, k, t, la, lo) for k, (u, t, la, lo) in enumerate(rows)]
    df = spark.createDataFrame(rows + rows[:5], T)
    study = Study(large=50, merge_within_s=60)
    points = trips.extract_trips(df, study)
    ends = trips.trip_ends(points).orderBy("track", "trip").collect()
    assert [(r["track"], r["how"]) for r in ends] == [("a/1", "cluster")] * 3
    assert all(r["end_t"] > r["start_t"] and r["n"] >= 10 and r["end_lat"] - r["start_lat"] > 0.03 for r in ends)
    # Less than an hour apart, all are one, with the points of the stops between them but their first and last two.
    one = trips.trip_ends(trips.extract_trips(df, Study(large=50, merge_within_s=3600))).collect()
    assert len(one) == 1 and one[0]["n"] > sum(r["n"] for r in ends)
    assert trips.extract_trips(df.limit(0), study).count() == 0
    # Small tracks go by windows; where these find nothing, by stops.
    assert {r["how"] for r in trips.trip_ends(trips.extract_trips(df, Study(large=10**6))).collect()} <= {"window", "cluster"}


def test_merge_takes_inner_points_of_stops(spark):
    legs = spark.createDataFrame([("a", "a#0", k, "cluster", 10 * k + j, (100 * k + j) * S, 45.0, 11.0) for k in range(2) for j in range(3)], "track string, part string, trip long, how string, id long, t long, lat double, lon double")
    stops = spark.createDataFrame([("a#0", 1, j, 900 + j, (50 + j) * S, 45.0, 11.0) for j in range(6)], "part string, stop long, pos long, id long, t long, lat double, lon double")
    got = trips.merge_trips(legs, stops, 200 * S).collect()
    assert sorted(r["id"] for r in got) == [0, 1, 2, 10, 11, 12, 901, 902, 903] and {r["trip"] for r in got} == {0}
    apart = trips.merge_trips(legs, stops, 50 * S).collect()
    assert sorted((r["trip"], r["id"]) for r in apart) == [(0, 0), (0, 1), (0, 2), (1, 10), (1, 11), (1, 12)]


def test_inside_spans(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(10**11), k) for k in range(300)]
    spans = [(rng.choice("ab"), a := rng.randrange(10**11), a + rng.randrange(-10, 3 * 10**10), k) for k in range(40)]
    got = trajectory.inside_spans(spark.createDataFrame(rows + [("a", None, 999)], "u string, t long, k long"), spark.createDataFrame(spans, "u string, a long, b long, s long"), ["u"]).select("k", "s").collect()
    assert sorted(map(tuple, got)) == sorted((k, s) for u, t, k in rows for w, a, b, s in spans if u == w and a < t < b)


def test_stage_confidence_traces_and_ends(spark):
    stage = spark.createDataFrame([("x", 0, "car", 10, 30, 45.0, 11.0, 46.0, 12.0), ("x", 1, "bus", 30, 50, 46.0, 12.0, 47.0, 13.0), ("x", 1, "bus", 30, 50, 46.0, 12.0, 47.0, 13.0)], "track string, stage long, mode string, start_t long, end_t long, lat double, lon double, end_lat double, end_lon double")
    probs = spark.createDataFrame([("x", 10, "car", 0.5), ("x", 30, "car", 0.7), ("x", 31, "car", 0.1), ("x", 20, "bus", 0.9), ("x", 25, "car", None), ("x", 26, "car", float("nan"))], "track string, t long, mode string, prob double")
    got = sorted((r["stage"], r["confidence"]) for r in stages.stage_confidence(stage, probs).collect())
    assert got == [(0, pytest.approx(0.6)), (1, 0.0), (1, 0.0)]
    trace = spark.createDataFrame([("x", k, k, 45.0, 11.0) for k in (10, 20, 30, 40)], T)
    traced = {r["stage"]: [p["t"] for p in r["trace"]] for r in stages.stage_traces(stage.distinct(), trace).collect()}
    assert traced == {0: [10, 20, 30], 1: [30, 40, 50]}
    own = spark.createDataFrame([(1, 1, 5, 9), (1, 2, 9, 12), (2, 3, 1, 2)], "trip_id long, stage_id long, start_us long, end_us long")
    wide = stages.widen_ends(own, spark.createDataFrame([(1, 4, 20)], "trip_id long, lo long, hi long"))
    assert sorted(map(tuple, wide.collect())) == [(1, 1, 4, 9), (1, 2, 9, 20), (2, 3, 1, 2)]


def test_calendar_and_clock(spark):
    df = spark.createDataFrame([(0,), (59_999_999,), (60_000_000,), (600_000_000,), (None,)], "t long")
    assert [tuple(r) for r in trajectory.calendar_counts(df, "t", 1, "minute").orderBy("start_t").collect()] == [(0, 2), (60_000_000, 1), (600_000_000, 1)]
    assert trajectory.calendar_counts(df, "t", 1, "minute", empty=True).count() == 11
    assert sum(r["n"] for r in trajectory.calendar_counts(df, "t", 1, "minute", strict=True).collect()) == 1
    with pytest.raises(ValueError):
        trajectory.calendar_part(F.col("t"), 1, "fortnight")


def test_density_clusters_in_time_and_far_north(spark):
    rng = np.random.default_rng(4)
    for eps, least, within, base in ((0.05, 4, 600, 45.0), (0.1, 3, None, 84.0), (0.03, 5, 60, -33.0)):
        n = 120
        lat, lon = base + np.cumsum(rng.normal(0, 2e-4, n)), 10 + np.cumsum(rng.normal(0, 4e-4, n))
        t = np.cumsum(rng.integers(1, 120, n)) * S
        near = [[j for j in range(n) if _km((lat[i], lon[i]), (lat[j], lon[j])) <= eps and (within is None or abs(t[i] - t[j]) <= within * S)] for i in range(n)]
        core = {i for i in range(n) if len(near[i]) >= least}
        label = {i: i for i in core}
        for _ in range(n):
            label = {i: min(label[j] for j in near[i] if j in core) for i in core}
        want = {i: label[i] if i in core else min([label[j] for j in near[i] if j in core], default=None) for i in range(n)}
        df = spark.createDataFrame([("x", k, int(t[k]), float(lat[k]), float(lon[k])) for k in range(n)], T)
        assert {r["id"]: r["cluster"] for r in clusters.density_clusters(df, eps, least, within).collect()} == want


def test_a_dense_cell_keeps_no_pairs():
    n = 40_000
    rng = np.random.default_rng(5)
    label, core, border = clusters.dbscan(np.arange(n), 45 + rng.uniform(0, 1e-3, n), 11 + rng.uniform(0, 1e-3, n), 0.05, 10)
    assert core.all() and len(set(label.tolist())) == 1 and border == []
