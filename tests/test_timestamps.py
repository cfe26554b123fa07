from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from wayfare.functions.timestamps import compact_utc_us, read_instants, wall_to_utc_us, zone_names
from wayfare.operators.zones import PREFERRED, estimate_zones, instants_beside, normalise_instants


def us(*parts, micro=0):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000 + micro


# text, zone, day, expected
CASES = [
    ("20180602081500123", "Europe/Rome", None, us(2018, 6, 2, 6, 15, 0, micro=123000)),
    ("20180102081500", "Europe/Rome", None, us(2018, 1, 2, 7, 15)),
    ("1514880900", "Europe/Rome", None, us(2018, 1, 2, 8, 15)),
    ("1514880900123", "Europe/Rome", None, us(2018, 1, 2, 8, 15, micro=123000)),
    ("1514880900123456", "Europe/Rome", None, us(2018, 1, 2, 8, 15, micro=123456)),
    ("2018-01-02T08:15:00.123456789Z", "Europe/Rome", None, us(2018, 1, 2, 8, 15, micro=123456)),
    ("2018-01-02 08:15:00+0530", "Europe/Rome", None, us(2018, 1, 2, 2, 45)),
    ("2018-01-02 08:15:00-04", "Europe/Rome", None, us(2018, 1, 2, 12, 15)),
    ("2018-07-02 08:15:00 CET", "Europe/Rome", None, us(2018, 7, 2, 7, 15)),
    ("2018-07-02 08:15:00 Asia/Kolkata", "Europe/Rome", None, us(2018, 7, 2, 2, 45)),
    ("2018-07-02 08:15:00 Nowhere/Land", "Europe/Rome", None, None),
    ("20180310T074522Z", "Europe/Athens", None, us(2018, 3, 10, 7, 45, 22)),
    ("03/11/2018 04:46:47 AM", "America/New_York", "20180311", us(2018, 3, 11, 8, 46, 47)),
    ("12/03/2018 08:24:54", "Europe/London", "20180312", us(2018, 3, 12, 8, 24, 54)),
    ("02/03/2018 12:00:00 AM", "UTC", "20180302", us(2018, 3, 2)),
    ("02.03.2018 12:00:00", "UTC", None, us(2018, 3, 2, 12)),
    ("Sun, 01 Apr 2018 08:11:10 +0300", "UTC", None, us(2018, 4, 1, 5, 11, 10)),
    ("9 Sep 2018 08:54:19", "Europe/Rome", None, us(2018, 9, 9, 6, 54, 19)),
    ("2018-03-25 02:30:00", "Europe/Rome", None, us(2018, 3, 25, 1, 30)),  # skipped
    ("2018-10-28 02:30:00", "Europe/Rome", None, us(2018, 10, 28, 0, 30)),  # twice
    ("2018-03-25 02:30:00 Europe/Rome", "UTC", None, us(2018, 3, 25, 1, 30)),
    ("2018-06-31 08:15:00", "UTC", None, None),
    ("2018-13-04T09:00:00Z", "UTC", None, None),
    ("2018-06-11 25:10:00", "UTC", None, None),
    ("2018-06-11 23:59:60", "UTC", None, None),
    ("02/03/2018 13:00:00 PM", "UTC", None, None),
    ("00000000000000000", "UTC", None, None),
    ("2018-06-11 05:10:00", None, None, None),
    ("2018-06-11 05:10:00Z", None, None, us(2018, 6, 11, 5, 10)),
    ("n/a", "UTC", None, None),
    ("", "UTC", None, None),
    ("   ", "UTC", None, None),
    (None, "UTC", None, None),
    ("x" * 100_000, "UTC", None, None),
]


def test_forms(spark):
    rows = [(k, *c) for k, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "k int, text string, zone string, day string, expected long")
    got = {r.k: (r.text, r.out, r.expected) for r in read_instants(df, "text", "out", "zone", day="day").collect()}
    assert {k: v for k, v in got.items() if v[1] != v[2]} == {}
    assert len(got) == len(rows)


def test_extra_columns_and_empty(spark):
    df = spark.createDataFrame([], "text string, zone string, __w0 int, Y int")
    out = read_instants(df, "text", "out", "zone")
    assert out.columns == ["text", "zone", "__w0", "Y", "out"] and out.count() == 0


def test_compact(spark):
    df = spark.createDataFrame([("20180602081500123",), (" 20180602235959999 ",), ("20181302081500123",), ("",), (None,), ("2018",)], "t string")
    got = [r[0] for r in df.select(compact_utc_us(F.col("t"))).collect()]
    assert got == [us(2018, 6, 2, 8, 15, micro=123000), us(2018, 6, 2, 23, 59, 59, micro=999000), None, None, None, None]


def test_zone_estimate_uses_the_offset_history(spark):
    rows = []
    for day, off in (("2018-01-10", 1), ("2018-07-10", 2), ("2018-02-10", 1), ("2018-08-10", 2)):
        wall = datetime.fromisoformat(day + "T12:00:00")
        ingested = datetime(wall.year, wall.month, wall.day, 12 - off, 0, 5)
        rows.append(("u", day + " 12:00:00", None, ingested))
    df = spark.createDataFrame(rows, "u string, text string, zone string, got timestamp_ntz")
    out = normalise_instants(df, "u", "text", "zone", "at", ingested="got").collect()
    assert sorted(r["at"] for r in out) == sorted(us(r[3].year, r[3].month, r[3].day, r[3].hour) for r in rows)
    none = spark.createDataFrame([], "u string, w long, i long")
    assert estimate_zones(none, "u", "w", "i").count() == 0


def _ingested(spark, zone, n=60, late=0):
    from zoneinfo import ZoneInfo

    rows = []
    for k in range(n):
        at = datetime(2018, 1 + k % 12, 10 + k % 9, 3 + k % 15, tzinfo=timezone.utc)
        wall = at.astimezone(ZoneInfo(zone)).replace(tzinfo=timezone.utc)
        delay = 7_200_000_000 if k < late else (k % 10) * 1_000_000
        rows.append((zone, int(wall.timestamp()) * 1_000_000, int(at.timestamp()) * 1_000_000 + delay))
    return rows


def test_zones_of_any_offset_history(spark):
    zones = ["Asia/Kathmandu", "Pacific/Auckland", "Australia/Adelaide", "Europe/Rome", "America/New_York"]
    rows = [r for z in zones for r in _ingested(spark, z, late=5)]
    rows += [("wild", k * 10**12, 10**15 + k * 977 * 10**9) for k in range(30)] + [(None, 1, 2), ("x", None, 2), ("x", 1, None)]
    got = {r["s"]: r for r in estimate_zones(spark.createDataFrame(rows, "s string, w long, i long"), "s", "w", "i").collect()}
    assert {z: got[z]["zone"] for z in zones} == {z: z for z in zones}
    assert all(got[z]["violations"] == 5 and got[z]["rows"] == 60 for z in zones)
    assert got["wild"]["zone"] is None and set(got) == {*zones, "wild"}
    assert estimate_zones(spark.createDataFrame([], "s string, w long, i long"), "s", "w", "i").count() == 0


def test_no_offset_history_is_left_out(spark):
    """More histories than a few fit equally, and some differ only in the hours of one night."""
    hour = 3_600_000_000
    wide = [("wide", us(2018, 6, d, 12, 45) + 5 * hour, us(2018, 6, d, 12) + 10_000_000) for d in range(1, 20)]
    got = estimate_zones(spark.createDataFrame(wide, "s string, w long, i long"), "s", "w", "i", late_us=6 * hour).first()
    assert tuple(got) == ("wide", "Asia/Kathmandu", 0, 19)
    # Beirut changes at its midnight, Athens and Rome three hours later.
    night = [("night", us(2018, 3, 24, 22, k) + 3 * hour, us(2018, 3, 24, 22, k) + 5_000_000) for k in range(0, 60, 5)]
    night += [("night", us(2018, 3, 24, 21, k) + 2 * hour, us(2018, 3, 24, 21, k) + 5_000_000) for k in range(0, 60, 5)]
    got = estimate_zones(spark.createDataFrame(night, "s string, w long, i long"), "s", "w", "i").first()
    assert tuple(got) == ("night", "Asia/Beirut", 0, 24)
    troll = [("troll", us(2018, m, 5, 12 + (2 if 4 <= m <= 10 else 0)), us(2018, m, 5, 12)) for m in range(1, 13)]
    got = estimate_zones(spark.createDataFrame(troll, "s string, w long, i long"), "s", "w", "i").first()
    assert tuple(got) == ("troll", "Antarctica/Troll", 0, 12)
    none = estimate_zones(spark.createDataFrame(troll, "s string, w long, i long"), "s", "w", "i", candidates=[]).first()
    assert tuple(none) == ("troll", None, 24, 12)


def test_zones_by_counts_are_those_of_the_rows(spark):
    """Every zone scored row by row against every source: messy ones, rows days off, sentinels and years of odd offsets."""
    import random
    import re
    from zoneinfo import ZoneInfo

    rng, rows = random.Random(7), []
    for k in range(12):
        zone = ZoneInfo(rng.choice(["Asia/Kathmandu", "Europe/Rome", "America/St_Johns", "Australia/Lord_Howe", "Africa/Casablanca", "Asia/Beirut"]))
        years = [2018] if k < 8 else [2016, 2018] if k < 10 else [1971]
        for _ in range(rng.choice([1, 3, 30])):
            at = datetime(rng.choice(years), rng.randrange(1, 13), rng.randrange(1, 29), rng.randrange(24), rng.randrange(60), tzinfo=timezone.utc)
            wall = int(at.astimezone(zone).replace(tzinfo=timezone.utc).timestamp()) * 1_000_000
            off = rng.choice([0, 0, rng.randrange(-1, 25) * 60_000_000, rng.randrange(-9, 9) * 3_600_000_000, rng.randrange(-4, 4) * 86_400_000_000])
            rows.append((k, wall, int(at.timestamp()) * 1_000_000 + off + rng.randrange(3_000_000)))
    rows += [(1, us(1, 1, 1), us(2018, 1, 1)), (2, us(9999, 12, 31, 23), us(2018, 1, 1)), (3, us(2018, 1, 1), us(9999, 12, 31))]
    df = spark.createDataFrame(rows, "s int, w long, i long").cache()
    names = [z for z in zone_names() if z == "UTC" or re.match(r"(Africa|America|Antarctica|Asia|Atlantic|Australia|Etc|Europe|Indian|Pacific)/", z)]
    for early, late in ((1_000_000, 1_200_000_000), (-2_000_000, 20_000_000_000)):
        got = estimate_zones(df, "s", "w", "i", early_us=early, late_us=late).collect()
        delay = F.col("i") - wall_to_utc_us(F.col("w"), F.col("zone"))
        bad = F.when(delay < -early, 2).when(delay > late, 1).otherwise(0)
        tier = F.when(F.col("zone").isin(*PREFERRED), 0).when(F.col("zone").rlike("^(Antarctica|Etc)/"), 2).otherwise(1)
        each = df.crossJoin(spark.createDataFrame([(z,) for z in names], "zone string"))
        each = each.groupBy("s", "zone").agg(F.sum(bad).alias("v"), F.sum(F.abs(delay).cast("decimal(30,0)")).alias("d"), F.sum((bad > 0).cast("int")).alias("against"), F.count("w").alias("n"))
        best = each.groupBy("s").agg(F.min(F.struct("v", "d", tier.alias("tier"), "zone", "against", "n")).alias("b")).select("s", "b.*")
        expected = {r["s"]: (r["zone"] if r["against"] <= 0.4 * r["n"] else None, r["v"], r["n"]) for r in best.collect()}
        assert {r["s"]: tuple(r)[1:] for r in got} == expected and len(got) == 12


def test_instants_beside(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 50), ("a", 3, None), ("a", 250_000, None), ("b", 2, None)], "s string, k long, t long")
    assert {(r["s"], r["k"]): r["near"] for r in instants_beside(df, "s", "k", "t", "near").collect()} == {("a", 1): 50, ("a", 2): 50, ("a", 3): 50, ("a", 250_000): None, ("b", 2): None}


def test_filters_on_the_instant_do_not_repeat_the_reading(spark):
    df = spark.createDataFrame([("2018-01-01T00:00:00Z", "UTC")], "text string, zone string")
    read = read_instants(df, "text", "out", "zone")
    count = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")
    assert count(read) == count(read.where("out is not null and out > 5")) > 0
