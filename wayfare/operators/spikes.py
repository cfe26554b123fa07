"""Implausible readings per source: out of range, far from the source's usual, or held.

What is usual for a source comes from a mergeable sketch: counts, least and greatest values of coarse
buckets, combined map-side and merged across partitions, of a size that the range of values bounds.
It brackets a quantile; one more pass counts what lies inside the bracket and gives the exact value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.functions.columns import scratch
from wayfare.operators.chunked import chunk_of
from wayfare.session import cut

#: Rows that one key's bracket may hold before it is split further.
BRACKET_ROWS = 1_000_000
#: Rows of per-source statistics up to which they are broadcast (some 100 bytes each); more are joined by shuffle.
BROADCAST_SOURCES = 200_000


def coarse_bucket(value: Column) -> Column:
    """A whole number that never falls as ``value`` rises: about 4 % wide far from 0, 0.01 near it."""
    return F.signum(value) * F.floor(24.0 * F.log1p(F.abs(value) * 4.0))


def _at_rank(rank: str, up_to: Column, n: Column, value: Column) -> Column:
    """``value`` where the 0-based rank in column ``rank`` falls into this row's ranks."""
    return F.when((up_to > F.col(rank)) & (up_to - n <= F.col(rank)), value)


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, bucket, n, lo, hi): the mergeable sketch of a source's values: per coarse bucket the number of values, the
    least and the greatest. Its size is bounded by the range of values (some 300 buckets up to 160), not by their number;
    it is combined map-side and merged across partitions."""
    return df.groupBy(*keys, coarse_bucket(F.col(value)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def bracket(sketch: DataFrame, keys: list[str], low: str, high: str, q: float) -> DataFrame:
    """(keys, total, ra, rb, from_v, to_v, inside_n): the ranks on either side of ``q * (total - 1)``, two values that the
    values of these ranks cannot lie outside of, and how many values lie between them at most. A sketch row stands for ``n`` values between ``low`` and ``high``."""
    whole = Window.partitionBy(*keys)
    up_to = lambda c: F.sum("n").over(whole.orderBy(c).rangeBetween(Window.unboundedPreceding, 0))
    x = sketch.withColumns({"total": F.sum("n").over(whole), "up_low": up_to(low), "up_high": up_to(high)})
    at = F.lit(q) * (F.col("total") - 1)
    x = x.withColumns({"ra": F.floor(at), "rb": F.ceil(at)})
    # The value of rank r is at least the r-th least lower end, and at most the r-th least upper end.
    g = x.groupBy(*keys).agg(
        F.max("total").alias("total"), F.max("ra").alias("ra"), F.max("rb").alias("rb"),
        F.min(F.when(F.col("up_low") > F.col("ra"), F.col(low))).alias("from_v"), F.min(F.when(F.col("up_high") > F.col("rb"), F.col(high))).alias("to_v"),
    )
    touched = sketch.join(g, keys).where((F.col(high) >= F.col("from_v")) & (F.col(low) <= F.col("to_v")))
    return touched.groupBy(*keys, "total", "ra", "rb", "from_v", "to_v").agg(F.sum("n").alias("inside_n"))


def quantile_in(df: DataFrame, keys: list[str], value: str, brackets: DataFrame, q: float, out: str, most_rows: int = BRACKET_ROWS) -> DataFrame:
    """(keys, out): the exact quantile with linear interpolation of the values of ``df`` (keys, value), given brackets.

    One pass counts the values below the bracket and each value inside it, combined map-side. Only the values inside,
    a few per cent, are ranked in one window per key. While a bracket holds more than ``most_rows`` rows, one more pass
    splits it into a thousand parts and takes the one or two that matter, so no window grows with its source."""
    inside = F.col(value).between(F.col("from_v"), F.col("to_v"))
    def written(x: DataFrame) -> tuple[DataFrame, int, int]:
        """Brackets, written; how many; and the most rows that one still to be split holds."""
        x = cut(x)
        n, most = x.agg(F.count(F.lit(1)), F.max(F.when(F.col("from_v") < F.col("to_v"), F.col("inside_n")))).first()
        return x, n, most or 0

    brackets, size, most = written(brackets)
    while most > most_rows:
        part = F.floor((F.col(value) - F.col("from_v")) / F.nullif(F.col("to_v") - F.col("from_v"), F.lit(0.0)) * 1000)
        x = _beside(df, brackets, keys, size).where((F.col(value) < F.col("from_v")) | inside)
        parts = x.groupBy(*keys, "total", "ra", "rb", F.when(inside, F.coalesce(part, F.lit(0))).otherwise(-1).alias("bucket"))
        parts = parts.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
        parts = parts.withColumn("up", F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
        holds = lambda r: (F.col("up") > F.col(r)) & (F.col("up") - F.col("n") <= F.col(r))
        brackets = parts.where(holds("ra") | holds("rb")).groupBy(*keys, "total", "ra", "rb")
        brackets, size, most = written(brackets.agg(F.min("lo").alias("from_v"), F.max("hi").alias("to_v"), F.sum("n").alias("inside_n")))
    x = _beside(df, brackets, keys, size)
    below = F.col(value) < F.col("from_v")
    counted = x.where(below | inside).groupBy(*keys, "ra", "rb", "total", F.when(inside, F.col(value)).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    up = F.sum("n").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("up", up)
    ends = ranked.groupBy(*keys, "total", "ra").agg(*[F.max(_at_rank(r, F.col("up"), F.col("n"), F.col("v"))).alias(o) for r, o in (("ra", "va"), ("rb", "vb"))])
    return ends.select(*keys, (F.col("va") + (F.col("vb") - F.col("va")) * (F.lit(q) * (F.col("total") - 1) - F.col("ra"))).alias(out))


def _axes(df: DataFrame, source: str, values: list[str], bound: float) -> DataFrame:
    """(source, axis, value): the values of each column within ``bound``, one row each."""
    axes = F.array(*[F.struct(F.lit(k).alias("axis"), F.col(c).cast("double").alias("value")) for k, c in enumerate(values)])
    return df.where(F.col(source).isNotNull()).select(F.col(source).alias("source"), F.inline(axes)).where(F.abs("value") <= bound)


def median_fences(df: DataFrame, source: str, values: list[str], bound: float, times: float, most_rows: int = BRACKET_ROWS) -> DataFrame:
    """(source, mid_0, reach_0, mid_1, ...): per column the median and ``times`` the median distance from it, over the
    source's values within ``bound``. A source without such values in a column has nulls there."""
    rows, keys = _axes(df, source, values, bound), ["source", "axis"]
    sketch = cut(histogram(rows, keys, "value"))
    median = cut(quantile_in(rows, keys, "value", bracket(sketch, keys, "lo", "hi", 0.5), 0.5, "median", most_rows))
    # Distances of a bucket's values from the median lie between these two.
    x = sketch.join(median, keys)
    d = x.withColumns({"dmin": F.greatest(F.lit(0.0), F.col("lo") - F.col("median"), F.col("median") - F.col("hi")), "dmax": F.greatest(F.abs(F.col("lo") - F.col("median")), F.abs(F.col("hi") - F.col("median")))})
    away = _beside(rows, median, keys).select(*keys, F.abs(F.col("value") - F.col("median")).alias("away"))
    mad = quantile_in(away, keys, "away", bracket(d, keys, "dmin", "dmax", 0.5), 0.5, "mad", most_rows)
    axes = median.join(mad, keys)
    return axes.groupBy("source").agg(
        *[F.max(F.when(F.col("axis") == k, F.col("median"))).alias(f"mid_{k}") for k in range(len(values))],
        *[F.max(F.when(F.col("axis") == k, F.col("mad") * times)).alias(f"reach_{k}") for k in range(len(values))],
    )


def _beside(df: DataFrame, stats: DataFrame, keys: list[str], size: int | None = None) -> DataFrame:
    """Inner join of rows with a written table of statistics, one row a key; broadcast only after counting it."""
    return df.join(F.broadcast(stats) if (stats.count() if size is None else size) <= BROADCAST_SOURCES else stats, keys)


def _with_statistics(df: DataFrame, source: str, stats: DataFrame) -> DataFrame:
    """Left join of per-source statistics, which are written once; broadcast only after counting them."""
    stats = cut(stats)
    side = F.broadcast(stats) if stats.count() <= BROADCAST_SOURCES else stats
    return df.join(side, F.col(source) == F.col("source"), "left")


def held_rows(df: DataFrame, source: str, at_us: str, row_id: str, values: list[str], least: int, skip: float | None = None) -> DataFrame:
    """(row_id): rows within ``least`` or more successive rows of a source, by time then id, with equal ``values``.
    Runs of the single value ``skip`` count as rows in between but are not given.

    Windows run per (source, day). A run that reaches a day's edge is carried over by a table with
    one or two entries per (source, day): its length and values; only those short edge runs are
    looked at again. Rows with a null source, time or value are left out and do not interrupt.
    """
    usable = df.where(F.col(source).isNotNull() & F.col(at_us).isNotNull())
    for v in values:
        usable = usable.where(F.col(v).isNotNull())
    rows = usable.select(
        F.col(source).alias("source"), F.col(at_us).alias("at"), F.col(row_id).alias("id"),
        *[F.col(v).alias(f"v{k}") for k, v in enumerate(values)],
    ).withColumn("chunk", chunk_of(F.col("at")))
    value = F.struct(*[f"v{k}" for k in range(len(values))])
    near = Window.partitionBy("source", "chunk").orderBy("at", "id")
    same = [F.coalesce(F.lag(f"v{k}").over(near) == F.col(f"v{k}"), F.lit(False)) for k in range(len(values))]
    start = ~same[0]
    for s in same[1:]:
        start = start | ~s
    rows = rows.withColumn("rn", F.row_number().over(near))
    # A row's run begins at the last start up to it and ends before the next start after it.
    rows = rows.withColumn("begin", F.when(start, F.col("rn")))
    back = near.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("first", F.last("begin", ignorenulls=True).over(back))
    run = Window.partitionBy("source", "chunk", "first")
    rows = rows.withColumn("length", F.count(F.lit(1)).over(run)).withColumn("size", F.max("rn").over(Window.partitionBy("source", "chunk")))
    head, tail = F.col("first") == 1, F.col("first") + F.col("length") - 1 == F.col("size")
    wanted = F.lit(True) if skip is None else F.col("v0") != skip
    # Of a run of the skipped value at a day's edge one row is kept, so that it stands between the days around it.
    between = ~wanted & (head | tail) & (F.col("rn") == F.col("first"))
    kept = cut(
        rows.where((wanted & ((F.col("length") >= least) | head | tail)) | between)
        .select("source", "chunk", "id", "rn", "first", "length", head.alias("head"), tail.alias("tail"), value.alias("value"))
    )
    given = kept if skip is None else kept.where(F.col("value.v0") != skip)
    inside = given.where(F.col("length") >= least).select("id")
    # One entry per edge run, in order; runs of equal values that touch across days add up.
    edges = kept.where((F.col("rn") == F.col("first")) & (F.col("head") | F.col("tail")))
    far = Window.partitionBy("source").orderBy("chunk", "first")
    joins = F.lag("tail").over(far) & F.col("head") & (F.lag("value").over(far) == F.col("value"))
    grouped = edges.withColumn("fresh", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn(
        "group", F.sum("fresh").over(far.rowsBetween(Window.unboundedPreceding, 0))
    )
    whole = grouped.withColumn("total", F.sum("length").over(Window.partitionBy("source", "group")))
    late = whole.where((F.col("total") >= least) & (F.col("length") < least)).select("source", "chunk", "first")
    crossing = given.where(F.col("length") < least).join(late, ["source", "chunk", "first"], "left_semi").select("id")
    return inside.unionByName(crossing).select(F.col("id").alias(row_id))


def implausible_vectors(
    df: DataFrame,
    source: str,
    at_us: str,
    row_id: str,
    values: list[str],
    bound: float = 160.0,
    times: float = 12.0,
    least_held: int = 8,
) -> DataFrame:
    """(row_id): rows with a value beyond ``bound``, or further from the source's median than ``times`` its
    median distance, or held over ``least_held`` successive rows. NaN counts as null; a null is never flagged
    by itself, and a row with a null source only if it is beyond ``bound``. One row per flagged id."""
    clean = df.withColumns({v: F.when(~F.isnan(F.col(v).cast("double")), F.col(v)) for v in values})
    judged = _with_statistics(clean, source, median_fences(clean, source, values, bound, times))
    flag = F.lit(False)
    for k, v in enumerate(values):
        x = F.col(v).cast("double")
        flag = flag | F.coalesce(F.abs(x) > bound, F.lit(False)) | F.coalesce(F.abs(x - F.col(f"mid_{k}")) > F.col(f"reach_{k}"), F.lit(False))
    loud = judged.where(flag).select(row_id)
    return loud.unionByName(held_rows(clean, source, at_us, row_id, values, least_held)).distinct()


def implausible_speeds(
    df: DataFrame, source: str, at_us: str, row_id: str, speed: str, most: float = 100.0, times: float = 3.0, q: float = 0.9, least_held: int = 8, timed: DataFrame | None = None
) -> DataFrame:
    """(row_id): rows whose speed is below 0 or above ``most``, above ``times`` the ``q`` quantile of the source's
    speeds above 0 and at most ``most``, or one of ``least_held`` successive equal non-zero speeds. NaN counts as null.
    Only held speeds need the time: where that is costly to read, give the rows with it as ``timed`` and ``df`` without."""
    without_nan = lambda x: x.withColumn(speed, F.when(~F.isnan(F.col(speed).cast("double")), F.col(speed)))
    clean = without_nan(df)
    moving = clean.where((F.col(speed) > 0) & (F.col(speed) <= most))
    rows, keys = _axes(moving, source, [speed], most), ["source"]
    top = quantile_in(rows, keys, "value", bracket(histogram(rows, keys, "value"), keys, "lo", "hi", q), q, "top")
    top = top.select("source", (F.col("top") * times).alias("limit"))
    judged = _with_statistics(clean, source, top)
    x = F.col(speed).cast("double")
    flag = (x < 0) | (x > most) | F.coalesce(x > F.col("limit"), F.lit(False))
    held = held_rows(clean if timed is None else without_nan(timed), source, at_us, row_id, [speed], least_held, skip=0.0)
    return judged.where(flag).select(row_id).unionByName(held).distinct()


def hourly_fences(df: DataFrame, source: str, at_us: str, value: str, times: float = 3.0, accuracy: int = 1000) -> DataFrame:
    """(source, hour, n, lo, hi): per source and UTC hour of day the interquartile fences of ``value``, widened by
    ``times`` the interquartile range, from quantile sketches that merge across partitions. Null values are left out."""
    hour = F.pmod(F.floor(F.col(at_us) / F.lit(3_600_000_000)), F.lit(24)).cast("int")
    sketch = (
        df.where(F.col(source).isNotNull() & F.col(at_us).isNotNull() & F.col(value).isNotNull())
        .groupBy(F.col(source).alias("source"), hour.alias("hour"))
        .agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(F.col(value).cast("double"), [0.25, 0.75], accuracy).alias("q"))
    )
    reach = (F.col("q")[1] - F.col("q")[0]) * times
    return sketch.select(F.col("source").alias(source), "hour", "n", (F.col("q")[0] - reach).alias("lo"), (F.col("q")[1] + reach).alias("hi"))


def context_flags(
    df: DataFrame, source: str, at_us: str, row_id: str, values: list[str], times: float = 3.0, rate_times: float = 10.0, still: int = 20, accuracy: int = 1000
) -> DataFrame:
    """(row_id, axis, reason): readings that are implausible beside what is usual for their source at their hour of day.

    Reason 'fence': outside the quartiles widened by ``times`` the distance between them; 'rate': the change per second
    from the source's reading before is beyond the upper quartile of such changes by more than ``rate_times`` their
    distance; 'still': the last of ``still`` successive readings without any variance. Quartiles are of all readings of a
    (source, UTC hour of day, axis), from quantile sketches that merge across partitions. Readings in order of time, then
    id, are compared within a UTC day. Null and NaN readings, sources and times are left out; an axis that never varies in
    an hour has fences of no width and flags what differs. A reading has a row for each reason.
    """
    rows = df.where(F.col(source).isNotNull() & F.col(at_us).isNotNull()).select(F.col(source).alias("source"), F.col(at_us).alias("at"), F.col(row_id).alias("id"), *[F.col(v).cast("double").alias(f"v{k}") for k, v in enumerate(values)])
    near = Window.partitionBy("source", "chunk").orderBy("at", "id")
    last = near.rowsBetween(1 - still, 0)
    rows = rows.withColumn("chunk", chunk_of(F.col("at"))).withColumn("was", F.lag("at").over(near))
    flat = {}
    for k in range(len(values)):
        v = f"v{k}"
        seconds = F.nullif((F.col("at") - F.col("was")) / 1e6, F.lit(0.0))
        flat[f"r{k}"] = F.abs(F.col(v) - F.lag(v).over(near)) / seconds
        flat[f"s{k}"] = (F.count(v).over(last) == still) & (F.max(v).over(last) == F.min(v).over(last))
    rows = rows.withColumns(flat)
    hour = F.pmod(F.floor(F.col("at") / F.lit(3_600_000_000)), F.lit(24)).cast("int")
    axes = F.array(*[F.struct(F.lit(name).alias("axis"), F.col(f"v{k}").alias("v"), F.col(f"r{k}").alias("rate"), F.col(f"s{k}").alias("still")) for k, name in enumerate(values)])
    long_ = rows.select("source", hour.alias("hour"), "id", F.inline(axes)).where(F.col("v").isNotNull() & ~F.isnan("v"))
    keys = ["source", "hour", "axis"]
    usual = long_.groupBy(*keys).agg(F.percentile_approx("v", [0.25, 0.75], accuracy).alias("q"), F.percentile_approx("rate", [0.25, 0.75], accuracy).alias("p"))
    wide = (F.col("q")[1] - F.col("q")[0]) * times
    usual = usual.select(*keys, (F.col("q")[0] - wide).alias("lo"), (F.col("q")[1] + wide).alias("hi"), (F.col("p")[1] + (F.col("p")[1] - F.col("p")[0]) * rate_times).alias("most"))
    found = long_.join(usual, keys).select(
        F.col("id").alias(row_id), "axis",
        F.explode(F.array_compact(F.array(
            F.when((F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi")), "fence"), F.when(F.col("rate") > F.col("most"), "rate"), F.when(F.col("still"), "still")
        ))).alias("reason"),
    )
    return found
