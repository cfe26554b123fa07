"""Stops and trips against the definition, with abutting, drifting and resting devices cut into short stretches."""

import random

import numpy as np
import pytest

from tests.test_problems import _brute
from wayfare.operators import mobility

MIN = 60_000_000
LEAST, SILENCE = 10 * MIN, 60 * MIN


def _points(rng):
    n, t, kind = rng.randint(1, 150), rng.randrange(10**9), rng.choice(["drift", "mix", "rest", "copies"])
    lat, lon, step, rows = 45 + rng.random() * 20, rng.choice([11.0, 179.9999, -120.0]), rng.choice([1e-5, 3e-5, 6e-5, 1e-4]), []
    for k in range(n):
        t += rng.choice([20, 60, 60, 90, 300]) * 1_000_000 + (rng.choice([1, 2]) * SILENCE if rng.random() < 0.02 else 0)
        if kind == "drift":
            lat, lon = lat + step * rng.random(), lon + step * (rng.random() - 0.3)
        if kind == "mix" and (k // 20) % 2:
            lat += 0.001
        if kind == "copies" and rng.random() < 0.1:
            lat += rng.choice([0, 3e-4, -3e-4, 5e-4])
        noise = 0 if kind == "copies" else rng.choice([0, 1e-4, 3e-4, 4.2e-4])
        spike = 5.0 if rng.random() < 0.01 else 0.0
        rows.append((t, lat + rng.uniform(-noise, noise) + spike, (lon + rng.uniform(-noise, noise) + 180) % 360 - 180, k))
    return rows


def _joined(points, width):
    """Stops and trips joined over stretches of ``width``, and how many rounds of repairs it took."""
    t, lat, lon, ids = (np.array(c) for c in zip(*points))
    lat, lon, chunk = np.radians(lat), np.radians(lon), t // width

    def summary(c, p0):
        own = np.flatnonzero(chunk == c)
        x = slice(max(0, own[0] - 1), own[-1] + 2)
        return mobility._summary(t[x], ids[x], lat[x], lon[x], chunk[x] != c, p0, 100.0, LEAST, SILENCE, 300.0)

    known, rounds = {c: summary(c, 0) for c in sorted(set(chunk.tolist()))}, 0
    while True:
        one = mobility._Joined(100.0, LEAST, SILENCE)
        for c, s in known.items():
            if s is not None:
                one.add(c, s)
        if not one.again:
            return {(k, a[2], b[2]) for k, a, b in one.result()}, rounds
        known |= {c: summary(c, p0) for c, p0 in one.again}
        rounds += 1


@pytest.mark.parametrize("seed", range(4))
def test_stretches_against_the_definition(seed):
    rng, rounds = random.Random(seed), 0
    for _ in range(60):
        points = _points(rng)
        want = _brute(points)
        for width in (10**15, 120 * MIN, 25 * MIN, 7 * MIN):
            got, n = _joined(points, width)
            assert got == want
            rounds += n
    assert rounds  # some stretches had to be done again


def test_spark_joins_stretches(spark):
    rng, rows, want = random.Random(7), [], set()
    for who in range(12):
        points = _points(rng)
        want |= {(str(who), k, a + 1000 * who, b + 1000 * who) for k, a, b in _brute(points)}
        rows += [(str(who), t, 1000 * who + i, lat, lon) for t, lat, lon, i in points]
    pings = spark.createDataFrame(rng.sample(rows, len(rows)), "device string, at long, id long, lat double, lon double")
    got = mobility.stops_and_trips(pings, stretch_us=25 * MIN).collect()
    assert {(r["device"], r["kind"], r["first_id"], r["last_id"]) for r in got} == want and len(got) == len(want)


def test_a_device_at_rest_is_linear():
    n, rng = 300_000, np.random.default_rng(1)
    t, noise = np.arange(n) * 1_000_000, 2e-4
    lat, lon = np.radians(45 + rng.uniform(-noise, noise, n)), np.radians(11 + rng.uniform(-noise, noise, n))
    last, corners, extremes = mobility.reach(lat, lon, 0, n, 100.0)
    assert last == n - 1 and len(corners) < 60 and len(extremes) < 500
    assert mobility.longest_stops(t, lat, lon, 0, n, 100.0, LEAST)[0] == [(0, n - 1)]


def test_the_penalty_divides_the_search_only():
    rng = random.Random(3)
    for _ in range(40):
        t, lat, lon, _ = (np.array(c) for c in zip(*_points(rng)))
        found = [mobility.longest_stops(t, np.radians(lat), np.radians(lon), 0, len(t), 100.0, LEAST, penalty)[0] for penalty in (0, 2, 50)]
        assert found[0] == found[1] == found[2]
    shown = np.array([5.0, 500, 500, 5, 500, 500, 500, 500, 500, 5, np.nan])
    assert mobility.segments_at_rest(shown, 100.0, 2) == [(0, 3), (9, 9)] and len(mobility.segments_at_rest(shown, 100.0, 0)) == 3
