import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfare.functions import encodings
from wayfare.operators import clusters, modes, stages, trajectory
from wayfare.operators.features import haar
from wayfare.operators.provenance import parse_model_info
from wayfare.sources.places import nearby

T = "track int, id long, t long, lat double, lon double"


def test_mean_pair_speed(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for track in range(5):
        t, lat, lon, speeds = 10**15, 40.0 + track, -8.0, []
        for k in range(track * 3 + 1):
            rows.append((track, k, t, lat, lon))
            s, dlat = rng.randint(1, 900), rng.choice([0.0, 0.01, -0.02])
            t, lat = t + s * 1_000_000, lat + dlat
            speeds.append(6371.0 * np.radians(abs(dlat)) / s * 3600)
        want[track] = np.mean(speeds[:-1]) if len(speeds) > 1 else None
    got = {r["track"]: r["kmh"] for r in trajectory.mean_pair_speed(spark.createDataFrame(rows, T), ["track"]).collect()}
    assert got[0] is None and all(got[k] == pytest.approx(want[k]) for k in range(1, 5))
    same = spark.createDataFrame([(0, 0, 5, 40.0, 1.0), (0, 1, 90_000_000, 40.0, 1.0)], T)
    assert trajectory.mean_pair_speed(same, ["track"]).first()["kmh"] == 0


def test_window_trips_against_a_fold(spark):
    rng = np.random.default_rng(1)
    n = 600
    t = np.sort(rng.choice(86_000, n, replace=False)).astype(int) * 1_000_000
    lat, lon = 46 + np.cumsum(rng.choice([0, 0, 2e-3], n)), 11 + np.zeros(n)
    df = spark.createDataFrame([(0, k, int(t[k]), float(lat[k]), 11.0) for k in range(n)], T)
    got = [(r["start_id"], r["end_id"], r["n"]) for r in trajectory.window_trips(df, 3000, 600, 0.5, 2, 5).orderBy("trip").collect()]
    cat = {}
    for k in range(0, 86400 - 3000, 600):
        inside = [i for i in range(n) if k * 1_000_000 <= t[i] <= (k + 600) * 1_000_000]
        if inside and inside[0] not in cat:
            a, b = inside[0], inside[-1]
            cat[a] = int(2 * 6371 * np.arcsin(abs(np.sin(np.radians(lat[b] - lat[a]) / 2))) >= 0.5)
    want, trip, noise = [], None, 0
    for i in range(n):
        c = cat.get(i, -1)
        if trip is None:
            if c == 1:
                trip, noise = [i], 0
        elif c == 0 and noise > 2:
            want.append(trip)
            trip = None
        else:
            noise += c == 0
            trip.append(i)
    assert got == [(x[0], x[-1], len(x)) for x in want if len(x) > 5]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 30)), max_size=60))
def test_clusters_hold_each_point_once(points):
    t = np.arange(len(points), dtype=np.int64)
    lat = np.array([46 + a * 1e-3 for a, _ in points])
    lon = np.array([11 + b * 1e-3 for _, b in points])
    found = clusters.ordered_clusters(t, lat, lon, 0.8, 0.5, 4) if points else []
    flat = [i for c in found for i in c]
    assert len(flat) == len(set(flat)) and all(len(c) >= 4 for c in found)


def test_density_clusters_against_brute_force(spark):
    rng = np.random.default_rng(2)
    p = np.vstack([rng.normal([46, 11], 3e-4, (20, 2)), rng.normal([46.02, 11.02], 3e-4, (20, 2)), rng.uniform(45.9, 46.1, (10, 2)) - [0, 35]])
    df = spark.createDataFrame([(0, k, k, float(a), float(b)) for k, (a, b) in enumerate(p)], T)
    got = {r["id"]: r["cluster"] for r in clusters.density_clusters(df, 0.1, 5).collect()}

    def km(a, b):
        x, y = np.radians(p[a]), np.radians(p[b])
        h = np.sin((y[0] - x[0]) / 2) ** 2 + np.cos(x[0]) * np.cos(y[0]) * np.sin((y[1] - x[1]) / 2) ** 2
        return 2 * 6371 * np.arcsin(np.sqrt(h))

    near = [[j for j in range(len(p)) if km(i, j) <= 0.1] for i in range(len(p))]
    core = {i for i in range(len(p)) if len(near[i]) >= 5}
    label = {i: i for i in core}
    changed = True
    while changed:
        changed = False
        for i in core:
            low = min(label[j] for j in near[i] if j in core)
            if low < label[i]:
                label[i], changed = low, True
    want = {i: label[i] if i in core else min([label[j] for j in near[i] if j in core], default=None) for i in range(len(p))}
    assert got == want


def test_majority_vote_keeps_rows_and_rest(spark):
    rows = [(0, k, k, m, 0.9) for k, m in enumerate(["still", "still", "car", "still", "walk", "car", "car"])] + [(1, 9, 9, "still", 0.5)]
    df = spark.createDataFrame(rows, "track int, id long, t long, mode string, prob double")
    got = {r["id"]: r["mode"] for r in modes.majority_vote(df, 1, 1).collect()}
    assert got == {0: "still", 1: "car", 2: "car", 3: "walk", 4: "walk", 5: "car", 6: "car", 9: "still"}


def test_transitions(spark):
    trace = spark.createDataFrame([(0, 0, 0, 46.0, 11.0), (0, 1, 100, 46.1, 11.0), (0, 2, 200, 46.2, 11.0), (0, 3, 300, 46.3, 11.0), (1, 4, 0, 46.0, 11.0), (1, 5, 9, 46.1, 11.0)], T)
    changes = spark.createDataFrame([(0, 50, "walk"), (0, 150, "car"), (0, 210, "bus"), (0, 220, "walk"), (0, 230, "car")], "track int, t long, mode string")
    got = stages.transition_points(trace, changes).orderBy("track", "t").collect()
    assert [(r["track"], r["t"], r["mode"]) for r in got] == [(0, 0, "walk"), (0, 150, "car"), (0, 200, "bus"), (0, 220, "walk"), (1, 0, "car")]
    ends = trace.groupBy("track").agg(F.max("t").alias("end_t"))
    all_ = stages.stages(stages.transition_points(trace, changes), ends)
    assert all_.where("track = 0").count() == 4 and stages.stages(stages.transition_points(trace, changes), ends, keep_last=False).where("track = 0").count() == 3


def test_haar(spark):
    row = spark.range(1).select(haar(F.array(*map(F.lit, [1.0, 2.0, 3.0, 4.0])), 4).alias("h")).first()
    assert row["h"] == pytest.approx([5.0, -2.0, -(0.5**0.5), -(0.5**0.5)])


def test_model_info(spark):
    df = spark.createDataFrame([("Forest(depth=2,loss='log',init=None)",), ("what",), (None,), ("",)], "m string")
    got = parse_model_info(df, "m").collect()
    assert got[0]["algorithm"] == "Forest" and got[0]["settings"] == {"depth": "2", "loss": "'log'", "init": "None"}
    assert all(r["algorithm"] is None and r["settings"] is None for r in got[1:])


def test_merge_of_empty_collections(spark):
    e = encodings.collection(F.array().cast("array<string>"))
    got = spark.range(1).select(encodings.merged(e, encodings.collection(F.array(F.lit("{}")))).alias("m")).first()["m"]
    assert got == '{"type":"FeatureCollection","features":[{}]}'


def test_nearby_far_north(spark):
    points = spark.createDataFrame([(1, 69.9999, 20.0), (2, None, 20.0)], "id long, lat double, lon double")
    pois = spark.createDataFrame([(k, str(k), 70.0 + 0.001 * k, 20.0 + 0.01 * k) for k in range(5)], "poi_id long, label string, lat double, lon double")
    assert [r["poi_id"] for r in nearby(points, pois, 0.5, 9).orderBy("rank").collect()] == [0, 1]
