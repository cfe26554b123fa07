import random

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from wayfare.operators import stages
from wayfare.sources.tracks import day_tracks, mode_sequence

FOLDER = "/root/testdata/sf0.001"


def _project(trace, changes):
    """(t, mode) by the rules of the projection, hop by hop: each change looked at for each hop."""
    out = []
    for (t, *_), (t2, *_) in zip(trace, trace[1:]):
        inside = [c for c in changes if t < c[0] < t2]
        before = [c for c in changes if c[0] < t]
        last = before[-1][1] if before else None
        if not changes:
            out.append((t, "car"))
        elif not inside:
            out.append((t, last or changes[0][1]))
        elif len(inside) == 1:
            out += [(t, last or inside[0][1]), inside[0]]
        else:
            out.append((t, inside[0][1]))
            out += [(inside[j][0], inside[min(j, len(inside) - 2)][1]) for j in range(1, len(inside))]
    return [p for k, p in enumerate(out) if k == 0 or p[1] != out[k - 1][1]]


def test_projection_against_a_hop_by_hop_reading(spark):
    rng = random.Random(3)
    trace, changes, want = [], [], set()
    for track in range(40):
        own = [(t, rng.random(), rng.random()) for t in sorted(rng.choices(range(200), k=rng.randint(1, 25)))]
        mine = [(t, rng.choice("abc")) for t in sorted(rng.sample(range(200), rng.choice([0, 1, 5, 40, 120])))]
        trace += [(track, k, *p) for k, p in enumerate(own)]
        changes += [(track, *c) for c in mine]
        want |= {(track, k, *p) for k, p in enumerate(_project(own, mine))}
    got = stages.transition_points(
        spark.createDataFrame(rng.sample(trace, len(trace)), "track int, id long, t long, lat double, lon double"),
        spark.createDataFrame(rng.sample(changes, len(changes)), "track int, t long, mode string"),
    ).collect()
    assert sorted((r["track"], r["t"], r["mode"]) for r in got) == sorted((track, t, mode) for track, _, t, mode in want)


def _days(spark):
    """(trace, predicted modes) of each track, in order."""
    traces, modes_ = {}, {}
    for r in sorted(day_tracks(spark, FOLDER).collect(), key=lambda r: (r["t"], r["id"])):
        traces.setdefault(r["track"], []).append((r["t"],))
    for r in sorted(mode_sequence(spark, FOLDER).collect(), key=lambda r: (r["t"], r["id"])):
        modes_.setdefault(r["track"], []).append((r["t"], r["mode"]))
    return {k: (v, modes_.get(k, [])) for k, v in traces.items()}


def _cleaned(rows):
    order = ["walk", "bike", "car", "bus", "train"]
    out = []
    for k in range(len(rows)):
        near = [m for _, m in rows[max(0, k - 2) : k + 3] if m != "still"]
        out.append((rows[k][0], max(order, key=lambda m: (near.count(m), -order.index(m))) if near else "still"))
    return [p for k, p in enumerate(out) if k == 0 or p[1] != out[k - 1][1]]


def test_transition_points_look_at_every_hop(spark):
    want = [(k, *p) for k, (trace, seen) in _days(spark).items() for p in _project(trace, _cleaned(seen))]
    got = entry.queries()["transition_points"](spark, FOLDER).collect()
    assert sorted((r["track"], r["t"], r["mode"]) for r in got) == sorted(want) and len({m for *_, m in want}) > 3


@pytest.mark.parametrize("name", ["stages_all", "stages_strict"])
def test_stages_reach_the_end_of_the_track(spark, name):
    want = set()
    for track, (trace, seen) in _days(spark).items():
        p = _project(trace, _cleaned(seen))
        ends = [t for t, _ in p[1:]] + [trace[-1][0]]
        spans = [(track, mode, a, b) for (a, mode), b in zip(p, ends)]
        want |= set(spans if name == "stages_all" or len(p) == 1 else spans[:-1])
    got = entry.queries()[name](spark, FOLDER).collect()
    assert {(r["track"], r["mode"], r["start_t"], r["end_t"]) for r in got} == want and len(got) == len(want)


def test_haar_of_all_values_against_its_matrix_and_sql(spark):
    names = [f"h{k}" for k in range(64)]
    df = entry.queries()["haar_features_full"](spark, FOLDER)
    assert df.columns == ["id", *names]
    got = {r["id"]: list(r)[1:] for r in df.collect()}
    basis = [np.full(64, 1 / 8)]
    for n in (64, 32, 16, 8, 4, 2):
        for a in range(0, 64, n):
            row = np.zeros(64)
            row[a : a + n // 2], row[a + n // 2 : a + n] = n**-0.5, -(n**-0.5)
            basis.append(row)
    e = pq.read_table(f"{FOLDER}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pydict()
    assert sorted(got) == sorted(e["vec_id"])
    for key, v in zip(e["vec_id"], e["embedding"]):
        assert got[key] == pytest.approx(list(np.array(basis) @ np.array(v, dtype=float)), abs=2e-6)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{FOLDER}/embeddings.parquet'")
    want = {r[0]: list(r[1:]) for r in con.execute(entry.oracle_sql()["haar_features_full"]).fetchall()}
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
