"""The operators for the general problems against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.operators.chunked import with_neighbours, with_running_sums
from wayfare.operators.grid import regular_grid
from wayfare.operators.intervals import periods_and_gaps
from wayfare.operators.mobility import longest_stops, stops_and_trips, usable_pings
from wayfare.operators.spikes import hourly_fences, implausible_speeds, implausible_vectors

MIN = 60_000_000
DAY = 86_400_000_000


def test_chunked_windows_equal_plain_ones(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(0, 5 * DAY), k, rng.randrange(10)) for k in range(300)]
    df = spark.createDataFrame(rows, "u string, t long, id long, v long").withColumn("c", (F.col("t") / DAY).cast("long"))
    got = with_running_sums(df, ["u"], "c", ["t", "id"], {"s": F.col("v")})
    got = with_neighbours(got, ["u"], "c", ["t", "id"], ["id"], "p", "n").collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: r[1:3]):
        by[r[0]].append(r)
    want = {}
    for rs in by.values():
        for k, r in enumerate(rs):
            want[r[2]] = (sum(x[3] for x in rs[: k + 1]), rs[k - 1][2] if k else None, rs[k + 1][2] if k + 1 < len(rs) else None)
    assert {r["id"]: (r["s"], r["p"] and r["p"]["id"], r["n"] and r["n"]["id"]) for r in got} == want


def test_periods_and_gaps(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), s := rng.randrange(0, 200) * 3_600_000_000, s + rng.randrange(-2, 9) * 3_600_000_000) for _ in range(120)]
    rows += [("a", None, 5), ("a", 5, None), *rows[:5]]
    df = spark.createDataFrame(rows, "who string, s long, e long")
    want = set()
    for who in "ab":
        merged = []
        for s, e in sorted((s, e) for w, s, e in rows if w == who and s is not None and e is not None and e > s):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        want |= {(who, "period", s, e) for s, e in merged}
        want |= {(who, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:]) if b[0] - a[1] <= 6 * 3_600_000_000}
    got = periods_and_gaps(df, "who", "s", "e", 6 * 3_600_000_000).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert periods_and_gaps(df.limit(0), "who", "s", "e").count() == 0


def test_grid(spark):
    at = [0, 10_000_000, 3 * MIN, 20 * MIN, 60 * MIN]
    rows = [("u", t, float(k)) for k, t in enumerate(at)] + [("u", 2 * MIN, None), ("u", None, 1.0), (None, 0, 1.0), ("u", MIN, float("nan"))]
    got = regular_grid(spark.createDataFrame(rows, "u string, t long, x double"), "u", "t", "x", carry_us=2 * MIN).collect()
    by = {r["bucket"]: r for r in got}
    assert sorted(by) == [*range(0, 21), 60]
    assert by[0]["value"] == 0.5 and by[1]["filled"] and by[2]["value"] == 0.5 and by[5]["value"] == 2.0 and by[6]["value"] is None
    assert [b for b, r in by.items() if r["readings"] == 0 and r["filled"]] and by[60]["recording"] == 2


def _held(rows, least, skip=()):
    out, by = set(), defaultdict(list)
    for u, t, i, v in rows:
        if u is not None and t is not None and None not in v:
            by[u].append((t, i, v))
    for rs in by.values():
        rs.sort()
        k = 0
        while k < len(rs):
            j = k
            while j + 1 < len(rs) and rs[j + 1][2] == rs[k][2]:
                j += 1
            if j - k + 1 >= least and rs[k][2] not in skip:
                out |= {r[1] for r in rs[k : j + 1]}
            k = j + 1
    return out


def test_spikes(spark):
    rng = random.Random(3)
    rows, t = [], 0
    for k in range(900):
        t += rng.choice([1, 1, 5 * 3600, 12 * 3600]) * 1_000_000
        held = 100 <= k < 112 or 300 <= k < 306 or 500 <= k < 540
        v = (1.0, 2.0, 3.0) if held else tuple(round(rng.gauss(0, 1), 2) for _ in range(3))
        if k % 97 == 0:
            v = (rng.choice([500.0, 40.0, -200.0]), v[1], v[2])
        if k % 53 == 0:
            v = (v[0], None, v[2])
        rows.append((rng.choice(["a", "a", "a", "b"]) if not held else "a", t if k % 71 else None, k, v))
    rows.append((None, 1, 5000, (0.0, 0.0, 0.0)))
    df = spark.createDataFrame([(u, t, i, *v) for u, t, i, v in rows], "u string, t long, id long, x double, y double, z double")
    want = _held(rows, 8)
    for axis in range(3):
        for who in "ab":
            vs = np.array([v[axis] for u, _, _, v in rows if u == who and v[axis] is not None and abs(v[axis]) <= 160])
            mid = np.median(vs)
            mad = np.median(np.abs(vs - mid))
            want |= {i for u, _, i, v in rows if u == who and v[axis] is not None and (abs(v[axis]) > 160 or abs(v[axis] - mid) > 12 * mad)}
    got = [r[0] for r in implausible_vectors(df, "u", "t", "id", ["x", "y", "z"]).collect()]
    assert set(got) == want and len(got) == len(want)
    assert implausible_vectors(df.limit(0), "u", "t", "id", ["x", "y", "z"]).count() == 0
    fences = hourly_fences(df, "u", "t", "x").collect()
    assert all(r["lo"] <= r["hi"] for r in fences)


def test_speeds(spark):
    rng = random.Random(4)
    rows = []
    for k in range(400):
        v = 0.0 if 50 <= k < 70 else 7.5 if 200 <= k < 210 else rng.choice([None, -1.0, 150.0, 90.0]) if k % 40 == 0 else round(rng.random() * 9, 2)
        rows.append(("a", k * 3_600_000_000, k, (v,)))
    df = spark.createDataFrame([(u, t, i, v[0]) for u, t, i, v in rows], "u string, t long, id long, v float")
    ok = np.array([np.float32(v[0]) for _, _, _, v in rows if v[0] is not None and 0 < v[0] <= 100], dtype=float)
    limit = 3 * np.quantile(ok, 0.9)
    want = _held(rows, 8, skip={(0.0,)}) | {i for _, _, i, v in rows if v[0] is not None and (v[0] < 0 or v[0] > 100 or v[0] > limit)}
    got = [r[0] for r in implausible_speeds(df, "u", "t", "id", "v").collect()]
    assert set(got) == want and len(got) == len(want)


def _track(rng, start, n):
    """Rests and moves with noise, a silence, and a spike."""
    rows, t, lat, lon = [], start, 45.0, 11.0
    for k in range(n):
        t += rng.choice([40, 60, 80]) * 1_000_000 + (2 * 3_600_000_000 if k == n // 2 else 0)
        if (k // 25) % 2:
            lat, lon = lat + 0.002, lon + 0.001
        spike = 5.0 if k == n // 3 else 0.0
        rows.append((t, lat + rng.uniform(-2e-4, 2e-4) + spike, lon + rng.uniform(-2e-4, 2e-4)))
    return rows


def _far(p, q):
    a, b, c, d = map(np.radians, (p[1], p[2], q[1], q[2]))
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 2 * 6371000 * np.arcsin(np.sqrt(h))


def _brute(points):
    """points: (t, lat, lon, id) in order; the stops and trips by the definition."""
    kmh = lambda p, q: _far(p, q) / ((q[0] - p[0]) / 1e6) * 3.6
    keep = [p for k, p in enumerate(points) if not (0 < k < len(points) - 1 and kmh(points[k - 1], p) > 300 and kmh(p, points[k + 1]) > 300)]
    sessions = [[]]
    for p in keep:
        if sessions[-1] and p[0] - sessions[-1][-1][0] > 3_600_000_000:
            sessions.append([])
        sessions[-1].append(p)
    out = set()
    for s in sessions:
        stops, k = [], 0
        while k < len(s):
            j = k
            while j + 1 < len(s) and all(_far(s[j + 1], q) <= 100 for q in s[k : j + 1]):
                j += 1
            if s[j][0] - s[k][0] >= 600_000_000:
                stops.append((k, j))
                k = j + 1
            else:
                k += 1
        out |= {("stop", s[a][3], s[b][3]) for a, b in stops}
        edges = [(None, -1), *stops, (len(s), None)]
        for (_, b), (a, _) in zip(edges, edges[1:]):
            if a > b + 1:
                out.add(("trip", s[max(b, 0)][3], s[min(a, len(s) - 1)][3]))
    return out


def test_stops_and_trips(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for who in ("u", "v"):
        points = [(*p, k + (0 if who == "u" else 1000)) for k, p in enumerate(_track(rng, 20 * 3_600_000_000, 220))]
        want[who] = _brute(points)
        rows += [(who, t, i, 10.0, lat, lon) for t, lat, lon, i in points]
        rows += [(who, t, i + 5000, 10.0, lat + 1, lon) for t, lat, lon, i in points[:9]]  # same instants, larger ids
        rows += [(who, 5, 9000, 500.0, 45.0, 11.0), (who, 6, 9001, 10.0, 0.0, 0.0), (who, 7, 9002, 10.0, 95.0, 1.0), (who, None, 9003, 10.0, 45.0, 11.0), (who, 8, 9004, None, 45.0, 11.0), (who, 9, 9005, 10.0, None, None)]
    df = spark.createDataFrame(rows, "who string, t long, id long, acc double, lat double, lon double")
    pings = usable_pings(df, "who", "t", "id", "acc", F.col("lat"), F.col("lon"))
    got = stops_and_trips(pings).collect()
    assert {(r["device"], r["kind"], r["first_id"], r["last_id"]) for r in got} == {(w, *x) for w, xs in want.items() for x in xs}
    assert all(r["duration_s"] >= 0 and r["distance_m"] >= 0 for r in got)
    assert stops_and_trips(pings.limit(0)).count() == 0


def test_segmentation_of_a_block():
    t = np.arange(30) * MIN
    lat, lon = np.radians(np.where(np.arange(30) < 15, 45.0, 45.01)), np.radians(np.full(30, 11.0))
    assert longest_stops(t, lat, lon, 0, 30, 100.0, 10 * MIN)[0] == [(0, 14), (15, 29)]
    assert longest_stops(t, lat, lon, 0, 5, 100.0, 10 * MIN)[0] == []
