import random
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.operators import spikes
from wayfare.operators.spikes import held_rows

DAY = 86_400_000_000
SCHEMA = "user string, at long, id long, speed double"


def _held(spark, rows, least=8):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(r["id"] for r in held_rows(df, "user", "at", "id", ["speed"], least, skip=0.0).collect())


def test_a_day_of_the_skipped_value_stands_between(spark):
    speeds = [(0, [1.0, *[7.0] * 5]), (1, [0.0] * 9), (2, [*[7.0] * 5, 2.0])]
    rows = [("u", d * DAY + k, d * 100 + k, v) for d, values in speeds for k, v in enumerate(values)]
    assert _held(spark, rows) == []
    assert _held(spark, [r for r in rows if r[3] != 0.0]) == [1, 2, 3, 4, 5, 200, 201, 202, 203, 204]


def test_held_rows_against_runs_of_the_whole_order(spark):
    rng = random.Random(5)
    rows, want = [], []
    for u in range(40):
        values = [v for _ in range(12) for v in [rng.choice([0.0, 0.0, 3.0, 4.0])] * rng.randint(1, 6)]
        days = sorted(rng.choice(range(12)) for _ in values)
        own = [(str(u), d * DAY + k, u * 1000 + k, v) for k, (d, v) in enumerate(zip(days, values))]
        rows += own
        for v, run in groupby(own, key=lambda r: r[3]):
            ids = [r[2] for r in run]
            want += ids if v != 0.0 and len(ids) >= 8 else []
    assert want and _held(spark, rng.sample(rows, len(rows))) == sorted(want)


@pytest.mark.parametrize("most_rows", [5, 1_000_000])
def test_quantiles_are_exact_however_often_brackets_are_split(spark, most_rows):
    rng = random.Random(6)
    rows = [("a", rng.gauss(0, 3)) for _ in range(801)] + [("b", rng.choice([1.0, 1.0, 2.0, -2.0])) for _ in range(300)] + [("c", 7.0)] + [("d", float(k)) for k in range(10)]
    df = spark.createDataFrame(rows, "source string, value double")
    for q in (0.5, 0.9):
        sketch = spikes.histogram(df, ["source"], "value")
        got = spikes.quantile_in(df, ["source"], "value", spikes.bracket(sketch, ["source"], "lo", "hi", q), q, "x", most_rows).collect()
        want = {k: np.quantile([v for u, v in rows if u == k], q) for k in "abcd"}
        assert {r["source"]: r["x"] for r in got} == pytest.approx(want)
    fences = {r["source"]: r for r in spikes.median_fences(df, "source", ["value"], 160.0, 1.0, most_rows).collect()}
    for k in "abcd":
        v = np.array([x for u, x in rows if u == k])
        assert (fences[k]["mid_0"], fences[k]["reach_0"]) == pytest.approx((np.median(v), np.median(np.abs(v - np.median(v)))))


def test_the_sketch_is_bounded_by_the_range_not_by_the_rows(spark):
    df = spark.range(200_000).select(F.lit("u").alias("source"), (F.rand(1) * 320 - 160).alias("value"))
    assert spikes.histogram(df, ["source"], "value").count() <= 320


def test_flags_beside_the_hour(spark):
    rng, rows = random.Random(7), []
    for who in "ab":
        t = 10**15
        for k in range(400):
            t += rng.choice([1, 20, 300]) * 1_000_000
            v = 1.0 if 100 <= k < 130 else rng.choice([50.0, None, float("nan")]) if k % 41 == 0 else round(rng.gauss(0, 1), 3)
            rows.append((who, t, k + (1000 if who == "b" else 0), v))
    rows += [(None, 5, 9000, 1.0), ("a", None, 9001, 99.0)]
    low = lambda xs, q: sorted(xs)[max(0, -(-len(xs) * q // 1).__int__() - 1)]
    want = set()
    for who in "ab":
        own = sorted((t, i, v) for u, t, i, v in rows if u == who and t is not None)
        good = [(k, t, i, v) for k, (t, i, v) in enumerate(own) if v is not None and v == v]
        rate = {}
        for k, t, i, v in good:
            p = own[k - 1] if k and own[k - 1][0] // DAY == t // DAY else None
            rate[i] = abs(v - p[2]) / ((t - p[0]) / 1e6) if p and p[2] is not None and p[2] == p[2] and t > p[0] else None
        for hour in {t // 3_600_000_000 % 24 for _, t, _, _ in good}:
            mine = [g for g in good if g[1] // 3_600_000_000 % 24 == hour]
            a, b = (low([v for *_, v in mine], q) for q in (0.25, 0.75))
            rates = [rate[i] for _, _, i, _ in mine if rate[i] is not None]
            c, d = (low(rates, q) for q in (0.25, 0.75)) if rates else (0, float("inf"))
            want |= {(i, "fence") for _, _, i, v in mine if v < a - 3 * (b - a) or v > b + 3 * (b - a)}
            want |= {(i, "rate") for _, _, i, _ in mine if rate[i] is not None and rate[i] > d + 10 * (d - c)}
        for k, t, i, v in good:
            last = [x for x in own[max(0, k - 19) : k + 1] if x[0] // DAY == t // DAY]
            if len(last) == 20 and all(x[2] == v for x in last):
                want.add((i, "still"))
    df = spark.createDataFrame([(u, t, i, v if v == v else None) for u, t, i, v in rows], "u string, t long, id long, x double")
    got = spikes.context_flags(df, "u", "t", "id", ["x"]).collect()
    assert {(r["id"], r["reason"]) for r in got} == want and {r for _, r in want} == {"fence", "rate", "still"}
    assert spikes.context_flags(df.limit(0), "u", "t", "id", ["x"]).count() == 0
