"""Scorers, stored rows, documents, graphs, providers, the command line and the whole way on small input."""

import json

import pytest
from pyspark.sql import functions as F

from wayfare import pipeline
from wayfare.__main__ import main
from wayfare.functions import encodings, geo
from wayfare.operators import learning, modes, provenance, scoring
from wayfare.settings import Study
from wayfare.sources import files, providers, rows, scans

FOLDER = "/root/testdata/sf0.001"
T = "track string, t long, lat double, lon double"


def _samples(spark, n=12):
    return spark.createDataFrame([("a", k % 2, k, k * 1000, float(k), 9.81, 0.0) for k in range(n)], "track string, trip long, id long, t long, x double, y double, z double")


def test_scorers(spark):
    s = _samples(spark)
    by_shake = scoring.ByShake().score(s).collect()
    assert all(sum(r["probs"]) == pytest.approx(1) and len(r["probs"]) == len(modes.LABELS) for r in by_shake)
    one_hot = scoring.ByFunction(lambda x: [[0, 0, 0, 1, 0, 0] for _ in range(len(x))]).score(s)
    assert {(r["mode"], r["prob"]) for r in scoring.predictions(one_hot).collect()} == {("bus", 1.0)}
    with pytest.raises(Exception, match="predictions"):
        scoring.ByFunction(lambda x: [[1.0]]).score(s).collect()
    cleaned = scoring.MajorityCleaning(1, 1).clean(scoring.predictions(one_hot).drop("trip"))
    assert cleaned.count() == 12 and isinstance(scoring.guess(spark.createDataFrame([("a", 0, 1, 2)], "track string, trip long, start_t long, end_t long")).first()["prob"], float)


def test_scores_by_position(spark):
    s = _samples(spark, 4).drop("trip")
    good = spark.createDataFrame([("a", k, k / 10) for k in range(4)], "track string, at long, p double")
    assert {r["id"]: r["p"] for r in scoring.beside_by_position(s, good, ["track"], ["t"], "at").collect()} == {0: 0.0, 1: 0.1, 2: 0.2, 3: 0.3}
    for wrong in (good.where("at < 3"), good.unionByName(spark.createDataFrame([("a", 4, 0.0)], good.schema))):
        with pytest.raises(Exception, match="differ in number"):
            scoring.beside_by_position(s, wrong, ["track"], ["t"], "at").collect()


def test_models_are_saved_and_scored_with(spark, tmp_path):
    x = _samples(spark, 64)
    learned = spark.range(64).select(F.col("id").alias("k"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: ((F.col("id") * 7 + i) % 11).cast("double")).alias("v"), (F.col("id") % 3).cast("int").alias("label"))
    vectors = learning.haar_vectors(learned, "k", "v", "label", 4)
    model = learning.logistic().fit(vectors)
    learning.save(model, str(tmp_path / "m"))
    again = learning.load(str(tmp_path / "m"))
    assert again.numClasses == model.numClasses == 3 and learning.accuracy(again.transform(vectors)) >= 0.3
    scored = scoring.ByModel(str(tmp_path / "m"), 4).score(x)
    assert scored.count() == 64 - 2 * 3 and all(len(r["probs"]) == 3 for r in scored.collect())
    best = learning.cross_validated(vectors, learning.logistic(), folds=3)
    assert len(best.avgMetrics) == 1
    mlp = learning.perceptron(4, 3, 5).fit(vectors)
    assert mlp.transform(vectors).count() == 64


def test_ranks_previews_and_vectors(spark):
    df = spark.createDataFrame([(["a", "b"], "b"), (["a", "b"], "a"), (["a", "b"], "z"), (None, "a")], "l array<string>, t string")
    assert modes.mean_reciprocal_rank(df, "l", "t").first()["mrr"] == pytest.approx(0.5)
    assert scoring.preview(spark.range(30), 20).splitlines()[-1] == "... 10 more" and len(scoring.preview(spark.range(3)).splitlines()) == 3
    v = spark.createDataFrame([(2.0,), (None,), (1.0,)], "x double").repartition(3).agg(scoring.sum_vector(F.col("x")).alias("v")).first()["v"]
    assert v.toArray().tolist() == [1.0, 2.0]


def test_documents(spark):
    df = spark.createDataFrame([(1, [(1, 45.0, 11.0), (1, 45.0, 11.0), (5, 46.0, 12.0)])], "k int, p array<struct<t:bigint,lat:double,lon:double>>")
    p = F.col("p")
    row = df.select(
        encodings.document(p, "points").alias("points"), encodings.document(p, "linestring").alias("line"), encodings.trip_document(p).alias("trip"),
        encodings.coloured_document(F.array(F.struct(F.lit("car").alias("mode"), p.alias("trace")), F.struct(F.lit("sledge").alias("mode"), p.alias("trace")))).alias("map"),
        encodings.json_path(p).alias("path"), encodings.share_url(F.lit('{"a": 1}')).alias("url"), encodings.hex_of(F.lit(255), F.lit(0), F.lit(10)).alias("hex"),
    ).first()
    points, line, trip, coloured = (json.loads(row[k]) for k in ("points", "line", "trip", "map"))
    assert [f["geometry"]["coordinates"] for f in points["features"]] == [[11.0, 45.0], [12.0, 46.0]]
    assert line["features"][0]["properties"] == {"timestamp-start": 1, "timestamp-end": 5} and len(line["features"][0]["geometry"]["coordinates"]) == 2
    assert [f["properties"].get("marker-symbol") for f in trip["features"]] == ["s", "e", None]
    assert [f["properties"]["stroke"] for f in coloured["features"]] == ["#ff0000", "#808080"]
    assert json.loads(row["path"]) == [[11.0, 45.0], [11.0, 45.0], [12.0, 46.0]]
    assert row["url"].endswith("%7B%22a%22%3A%201%7D") and row["hex"] == "#ff000a"
    assert len(set(encodings.hue_colours(24))) == 24
    with pytest.raises(ValueError):
        encodings.document(p, "polygon")


def test_stored_rows(spark):
    df = spark.createDataFrame([("u", [(0, 45.0, 11.0), (1_000, 46.5, 12.0)], "bus", 0.5, "O'Neil 1", "B", "f.json", None)], "user string, trace array<struct<t:bigint,lat:double,lon:double>>, mode string, confidence double, start_address string, stop_address string, json_file_path string, segment_confidence double")
    assert len(rows.trip_rows(df).columns) == 8 and len(rows.stage_rows(df).columns) == 11 and rows.stage_rows(df, keep=("mode",)).columns[0] == "mode"
    old = rows.stage_rows(df, json_file=False).first()
    assert old["start_address"] == "O'Neil 1" and old["stop_address"] == "B" and old["segment_confidence"] != old["segment_confidence"]
    pilot, study = rows.pilot_rows(df).first(), rows.pilot_rows(df, mapped="trace").first()
    assert pilot["start_address"] == "ONeil 1" and pilot["path"] == "[[11.000000,45.000000], [12.000000,46.500000]]" and json.loads(study["path_mapped"]) == [[11.0, 45.0], [12.0, 46.5]]
    asked = json.loads(rows.questionnaire(df.withColumns({"start_poi": F.lit("Mill"), "stop_poi": F.lit(None).cast("string")})).first()["json"])
    assert asked["uuid"] == "u" and [p["poi"] for p in asked["points"]] == ["Mill", "UNKNOWN"] and asked["points"][1]["point"] == [12.0, 46.5]
    names = spark.createDataFrame([('{"name":"","display_name":"D"}',), ('{"addresses":[{"address":{"streetName":"S"}}]}',), ("no",)], "j string").select(rows.address_label(F.col("j")).alias("n")).collect()
    assert [r["n"] for r in names] == ["D", "S", None]


def test_graph(spark):
    trip = spark.createDataFrame([("u", 1, 0, 10)], "user string, trip long, start_t long, end_t long")
    p = spark.createDataFrame([("u", 1, 0, "car", 0.5, "Forest(depth=2,loss='log')"), ("u", 1, 1, "bus", None, "guessed"), ("u", 1, 2, None, 0.1, "odd")], "user string, trip long, window long, label string, prob double, modelinfo string")
    g = provenance.study_graph(spark, "s", "1", {"detector": "stops", "eps": "0.1"}, trip, p, ["bad"], 3, True)
    got = {(r["s"].rsplit(":", 1)[-1], r["p"].rsplit("#", 1)[-1].rsplit(":", 1)[-1], r["o"].rsplit("#", 1)[-1]) for r in g.collect()}
    assert {("experiment/1", "removedOutliers", "3"), ("experiment/1", "error", "bad"), ("setting/Forest/depth=2", "hasValue", "2"), ("prediction/s/1/u/1/0", "label", "car")} <= got
    assert any(s == "run/s/1/u/1/1" and p_ == "executes" and o.endswith("implementation/guess") for s, p_, o in got)
    assert g.count() == g.distinct().count() and g.where("s is null or o is null").count() == 0
    lines = [r["value"] for r in provenance.turtle_lines(g).collect()]
    assert all(x.endswith(" .") and x.startswith("<") for x in lines)
    assert provenance.unmatched_trips(trip, p).count() == 0 and provenance.unmatched_trips(trip, p.limit(0)).count() == 1
    assert json.loads(provenance.run_record({"a": "b"}, ["e"], 2))["numRemovedOutliers"] == 2


def test_providers(spark):
    df = spark.createDataFrame([("a", k, 45.0, 11.0) for k in range(4)] + [("b", 0, 45.0, 11.0)], T)

    def ask(service, points):
        if len(points) == 1:
            raise OSError("down")
        return [(t, lat + 1, lon) for t, lat, lon in points]

    got = sorted(map(tuple, providers.Remote(providers.Service("http://example"), ask, ends=True).match(df).collect()))
    assert got == [("a", 0, 46.0, 11.0), ("a", 3, 46.0, 11.0), ("b", 0, 45.0, 11.0)]
    roads = spark.createDataFrame([(45.0001, 11.0), (50.0, 11.0)], "lat double, lon double")
    moved = providers.SnapToRoads(roads).match(df)
    assert {r["lat"] for r in moved.collect()} == {45.0001} and moved.count() == 5
    assert all(0.005 < r["km"] < 0.02 for r in providers.moved_km(df, moved).collect())
    body = df.groupBy("track").agg(F.sort_array(F.collect_list(F.struct("t", "lat", "lon"))).alias("p")).select(providers.request_body(F.col("p"), F.col("track")).alias("b")).first()["b"]
    assert "POINT (11.000000 45.000000)" in json.loads(body)[0]["point"]


def test_scans_and_exports(spark, tmp_path):
    p = scans.scan_positions(spark, FOLDER, users=scans.allowed_users(spark, FOLDER), below_m=50.0)
    day = p.first()["day"]
    one = scans.scan_positions(spark, FOLDER, day=day, users=[p.first()["user_id"]])
    assert 0 < one.count() < p.count() and {r["day"] for r in one.select("day").distinct().collect()} == {day}
    assert scans.scan_positions(spark, FOLDER, first=day, last=day).count() >= one.count()
    files.export_positions(one, str(tmp_path / "p"))
    files.export_positions(one, str(tmp_path / "q"), altitude=False)
    files.export_accelerations(scans.scan_accelerations(spark, FOLDER).limit(5), str(tmp_path / "a"))
    assert spark.read.csv(str(tmp_path / "p"), header=True).columns == ["timestamp", "latitude", "longitude", "altitude"]
    assert spark.read.csv(str(tmp_path / "q"), header=True).columns == ["timestamp", "longitude", "latitude"]
    (tmp_path / "acc.csv").write_text("timestamp,x,y,z\n20180102081500,0.5,1,2\n")
    assert files.read_accelerations(spark, str(tmp_path / "acc.csv")).first()["t"] == 1514880900000000
    assert list(scans.days_between("20180227", "20180302")) == ["20180227", "20180228", "20180301", "20180302"]
    assert scans.select_mapped(spark, "SELECT id FROM {t}", {"twice": "id * 2"}, t=spark.range(3)).agg(F.sum("twice")).first()[0] == 6


def test_change_of_speed_over_three_points(spark):
    at = lambda t, lat: F.struct(F.lit(t).alias("t"), F.lit(lat).alias("lat"), F.lit(11.0).alias("lon"))
    row = spark.range(1).select(geo.velocity_change_between(at(0, 45.0), at(10**7, 45.01), at(2 * 10**7, 45.03)).alias("r"), geo.velocity_change_between(at(0, 45.0), at(10**7, 45.0), at(2 * 10**7, 45.03)).alias("z")).first()
    assert row["r"] == pytest.approx(1.0, abs=1e-6) and row["z"] == 0


def test_the_whole_way(spark, tmp_path):
    done = pipeline.run(spark, FOLDER, study=Study(least_samples=150, large=30))
    stage = done.stages.collect()
    trip = {f"{r['track']}#{r['trip']}": r for r in done.trips.collect()}
    assert trip and {r["track"] for r in stage} == set(trip)  # every trip has stages
    for key, r in trip.items():
        own = sorted((s for s in stage if s["track"] == key), key=lambda s: s["stage"])
        assert own[0]["start_t"] == r["start_t"] and own[-1]["end_t"] == r["end_t"]
        assert all(a["end_t"] == b["start_t"] for a, b in zip(own, own[1:]))
        assert all([p["t"] for p in s["trace"]] == sorted(p["t"] for p in s["trace"]) for s in own)
    assert {r["model"] for r in stage} == {"scored", "guessed"}
    assert len(pipeline.stage_table(spark, FOLDER, done).columns) == 13 and pipeline.coloured_trips(done).count() == len(trip)
    # Of one day only the trips of that day, with the same accelerations.
    first = min(trip)
    day = first.split("/")[1].split("#")[0].replace("-", "")
    one = {f"{r['track']}#{r['trip']}" for r in pipeline.run(spark, FOLDER, day, study=Study(least_samples=150, large=30)).trips.collect()}
    assert one and all(scans.around(day, -1) <= k.split("/")[1].split("#")[0].replace("-", "") <= scans.around(day, 1) for k in one)
    main(["trips", FOLDER, "-o", str(tmp_path / "out")], spark)
    assert spark.read.parquet(str(tmp_path / "out/trips")).count() > 0
    main(["stages", FOLDER, "-o", str(tmp_path / "none"), "-d", "20180101", "-s", "--dryrun"], spark)
    assert not (tmp_path / "none").exists()
