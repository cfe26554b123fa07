from datetime import datetime

from pyspark.sql import functions as F

from wayfare.sources import files
from wayfare.sources.providers import FirstAndLast, Identity, match_by_mode
from wayfare.streaming import live


def test_stage_lines(spark, tmp_path):
    (tmp_path / "s.csv").write_text("bike,2019-11-02 06:41:00.250000,2019-11-02 06:58:30.500000,0.625,Stumps(rounds=40,loss='log')\n\nbad\n")
    rows = sorted(files.read_stages(spark, str(tmp_path / "s.csv")).collect(), key=lambda r: r["label"])
    assert rows[1]["model"] == "Stumps(rounds=40,loss='log')" and rows[1]["prob"] == 0.625 and rows[0]["prob"] is None


def test_positions(spark, tmp_path):
    (tmp_path / "p.csv").write_text('timestamp,latitude,longitude,altitude\n"20180102081500","46.5","11.25","3"\n')
    r = files.read_positions(spark, str(tmp_path / "p.csv")).first()
    assert (r["latitude"], r["longitude"], r["t"]) == (46.5, 11.25, 1514880900000000)
    (tmp_path / "q.csv").write_text("a,b\n0.25,0.75\n")
    assert files.read_probabilities(spark, str(tmp_path / "q.csv"), ["a", "b"]).first()["probs"] == [0.25, 0.75]


def test_gpx_round_trip(spark):
    df = spark.createDataFrame([(1, 2_000_000, 46.5, 11.25), (1, 1_000_000, 46.25, -11.5)], "track int, t long, lat double, lon double")
    back = files.read_gpx(files.gpx(df, "track"), "gpx").orderBy("pos").collect()
    assert [(r["lat"], r["lon"]) for r in back] == [(46.25, -11.5), (46.5, 11.25)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    files.write_delimited(df, str(tmp_path / "c"), ["v", "k"], "\t")
    files.append_rows(df, str(tmp_path), "t")
    files.append_rows(df, str(tmp_path), "t")
    files.write_documents(df, str(tmp_path / "d"), "v", "k")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4 and spark.read.text(str(tmp_path / "d")).count() == 2


def test_matching(spark):
    df = spark.createDataFrame([(1, k, 46.0, 11.0, "train") for k in range(5)] + [(2, k, 46.0, 11.0, None) for k in range(3)], "track int, t long, lat double, lon double, mode string")
    got = match_by_mode(df, "mode", Identity(), FirstAndLast()).groupBy("track").count().collect()
    assert {r["track"]: r["count"] for r in got} == {1: 2, 2: 3}


def test_sessions_of_a_stream(spark, tmp_path):
    at = lambda h, m: datetime(2018, 1, 1, h, m)
    rows = [("u", at(1, 0)), ("u", at(1, 30)), ("u", at(3, 0)), ("v", at(1, 0)), ("z", at(20, 0))]
    spark.createDataFrame(rows, "user string, ts timestamp").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("user string, ts timestamp").parquet(str(tmp_path / "in"))
    for name, frame in (("s", live.sessions(source, "user", "ts")), ("w", live.window_stats(source, "user", "ts", "1 hour"))):
        q = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted((r["user"], r["n"]) for r in spark.table("s").collect()) == [("u", 1), ("u", 2), ("v", 1)]
    assert spark.table("w").where("user = 'u'").count() == 2
