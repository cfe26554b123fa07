"""Mixed timestamp formats and zones: one instant in UTC per row, with estimates of missing zones.

A missing zone is estimated from the order of things: an event cannot have been ingested before
it happened, and seldom long after. Each candidate zone is a whole offset history, so a row
before and one after a daylight-saving change testify together; the history with the fewest
violations wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.functions.columns import floor_div, scratch
from wayfare.functions.timestamps import known_zone, read_instants, wall_to_utc_us, zone_names
from wayfare.session import cut

#: Quarters of an hour: all offsets of zones since 1972 but Liberia's and Guyana's are whole numbers of them.
GRID_US = 900_000_000
SECOND_US = 1_000_000
DAY_US = 86_400_000_000
#: No zone is further from UTC.
FURTHEST_US = 18 * 3_600_000_000
#: Share of a source's rows that may speak against its best history before it gets none.
MOST_VIOLATIONS = 0.4

# The names under which common histories are given.
PREFERRED = (
    "Europe/London", "Europe/Rome", "Europe/Athens", "Europe/Moscow", "America/New_York", "America/Chicago", "America/Denver",
    "America/Los_Angeles", "America/Sao_Paulo", "Asia/Kolkata", "Asia/Shanghai", "Asia/Tokyo", "Australia/Sydney", "UTC",
)
_LANDS = r"(Africa|America|Asia|Atlantic|Australia|Europe|Indian|Pacific)/"


def _rank(zone: str) -> tuple[int, str]:
    """Zones in the order in which ties are decided."""
    return (0 if zone in PREFERRED else 1 if re.match(_LANDS, zone) else 2), zone


@lru_cache(maxsize=16)
def offset_histories(years: tuple[int, ...], candidates: tuple[str, ...] | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(zones, starts, offsets): from wall clock time ``starts[k]`` on, up to the next, ``offsets[z, k]`` microseconds hold in
    zone z, for the wall clock times of the given years (1 to 9999); exact to the second, as :func:`wall_to_utc_us` reads them.

    The zones are those of continents and oceans, UTC, Antarctica and the fixed ones of the sea (or ``candidates``), in the
    order in which ties are decided; of those without a difference in these years only the first."""
    if candidates is None:
        candidates = tuple(z for z in zone_names() if z == "UTC" or re.match(rf"{_LANDS}|(Antarctica|Etc)/", z))
    offset = lambda at: at - wall_to_utc_us(at, F.col("zone"))
    first = lambda y: int(np.datetime64(y - 1970, "Y").astype("datetime64[D]").astype(int))
    asked = SparkSession.active().createDataFrame([(z, first(y), first(y + 1)) for z in candidates for y in years], "zone string, a long, b long")
    found = asked.select("zone", F.explode(F.sequence("a", F.col("b") - 1)).alias("at")).withColumn("at", F.col("at") * DAY_US)
    for step, parts in ((DAY_US, 1), (3600 * SECOND_US, 24), (60 * SECOND_US, 60), (SECOND_US, 60)):
        inner = F.sequence(F.col("at"), F.col("at") + (parts - 1) * step, F.lit(step))
        found = found.select("zone", F.explode(inner).alias("at")).where(offset(F.col("at")) != offset(F.col("at") + step))
    known = found.select("zone", (F.col("at") + SECOND_US).alias("at")).unionByName(asked.select("zone", (F.col("a") * DAY_US).alias("at")))
    changes: dict[str, list[tuple[int, int]]] = {}
    for zone, at, holds in known.distinct().select("zone", "at", offset(F.col("at"))).collect():
        changes.setdefault(zone, []).append((at, holds))
    starts = np.array(sorted({at for mine in changes.values() for at, _ in mine}), np.int64)
    histories: dict[bytes, tuple[str, np.ndarray]] = {}
    for zone in sorted(changes, key=_rank):
        at, holds = np.array(sorted(changes[zone]), np.int64).T
        offsets = holds[np.searchsorted(at, starts, "right") - 1]
        histories.setdefault(offsets.tobytes(), (zone, offsets))
    return [z for z, _ in histories.values()], starts, np.array([o for _, o in histories.values()], np.int64).reshape(len(histories), len(starts))


def estimate_zones(
    walls: DataFrame,
    source: str,
    wall: str,
    ingested_us: str,
    candidates: Sequence[str] | None = None,
    early_us: int = 1_000_000,
    late_us: int = 20 * 60_000_000,
) -> DataFrame:
    """One row per source: (source, zone, violations BIGINT, rows BIGINT).

    ``wall`` is a zoneless wall clock time in microseconds, of years 1 to 9999, ``ingested_us`` the ingestion instant. A row
    violates a history if the instant it implies lies more than ``early_us`` after ingestion (counted twice, it is
    impossible) or more than ``late_us`` before it (counted once, as late arrivals happen). The history with the fewest
    violations wins, then the one with the least total delay, then one of ``PREFERRED``, as a few days seldom tell a country
    with daylight saving from one without, then the first by name, those of Antarctica and the sea last. ``zone`` is null
    where even that one is violated by more than ``MOST_VIOLATIONS`` of the rows. With ``candidates`` only these zones are
    tried. Rows with a null wall clock or ingestion are left out; a source without any row gets none. Zones whose histories
    do not differ over the years of the data are given under one name.

    No history is left out: what a row says of any offset depends only on the least and the most offset it allows, in whole
    steps of the offsets in use, and on the one its delay changes sign at. Rows are counted by these, per source and wall
    clock day (or part of a day, where an offset changes within), with map-side combining, and every history is scored from
    the counts with the numbers that going through the rows would give.
    """
    (us,) = scratch(walls, 1)
    usable = walls.where(F.col(wall).isNotNull() & F.col(ingested_us).isNotNull() & F.col(source).isNotNull())
    usable = cut(usable.select(F.col(source).alias("source"), F.col(wall).alias("wall"), F.col(ingested_us).alias(us)))
    day = floor_div(F.col("wall"), DAY_US)
    year = F.greatest(F.lit(1), F.least(F.lit(9999), F.year(F.date_from_unix_date(day.cast("int")))))
    years = sorted(r[0] for r in usable.select(year.alias("year")).distinct().collect())
    zones, starts, offsets = offset_histories(tuple(years), None if candidates is None else tuple(candidates))
    # The offsets of most years are whole quarters of an hour; in a year where one is not, seconds are told apart.
    fine = sorted({int(y) for y, odd in zip(starts.astype("datetime64[us]").astype("datetime64[Y]").astype(int) + 1970, (offsets % GRID_US != 0).any(axis=0)) if odd})
    breaks: dict[int, list[int]] = {}
    for at in starts.tolist():
        breaks.setdefault(at // DAY_US, []).append(at)
    within = walls.sparkSession.createDataFrame(list(breaks.items()), "day long, breaks array<long>")
    usable = usable.withColumn("day", day).join(F.broadcast(within), "day", "left")
    slot = F.coalesce(F.array_max(F.filter("breaks", lambda b: b <= F.col("wall"))), F.col("day") * DAY_US)
    ahead = F.col("wall") - F.col(us)

    def steps(grid: int) -> Column:
        """The offsets least and most allowed, the last that is not above that of no delay, and what it leaves; those
        beyond the reach of any zone as one, where they say the same of every zone."""
        down = lambda c: F.greatest(F.lit(-FURTHEST_US - grid), F.least(F.lit(FURTHEST_US + grid), c - F.pmod(c, F.lit(grid))))
        base = down(ahead)
        rest = F.when(F.abs(ahead) <= FURTHEST_US, ahead - base).otherwise(0)
        return F.struct((-down(-(ahead - early_us))).alias("least"), down(ahead + late_us).alias("most"), base.alias("base"), rest.alias("rest"))

    told = steps(GRID_US) if not fine else F.when(year.isin(fine), steps(SECOND_US)).otherwise(steps(GRID_US))
    counts = usable.select("source", slot.alias("slot"), told.alias("told")).select("source", "slot", "told.*")
    counts = counts.groupBy("source", "slot", "least", "most", "base").agg(F.count(F.lit(1)).alias("n"), F.sum("rest").alias("rest"))
    kind = usable.schema["source"].dataType.simpleString()
    scored = counts.repartition("source").sortWithinPartitions("source", "slot").mapInArrow(_best_history(zones, starts, offsets), f"source {kind}, zone string, violations long, rows long")
    return scored.select(F.col("source").alias(source), "zone", "violations", "rows")


def _best_history(zones: list[str], starts: np.ndarray, offsets: np.ndarray):
    """For counts sorted by source: each source's best history, for ``mapInArrow``. What is held is one batch and four
    numbers per history, however many counts a source has."""
    same = lambda a, b: a == b or (a != a and b != b)

    def table(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        schema = {"source": kind, "zone": pa.string(), "violations": pa.int64(), "rows": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(schema.values())], list(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        score = np.zeros((4, len(zones)), np.int64)  # violations, seconds and microseconds of delay, rows against
        source, rows, kind = None, 0, None

        def best() -> tuple:
            if not zones:
                return source, None, 2 * rows, rows
            seconds = score[1] + score[2] // SECOND_US
            z = np.lexsort((score[2] % SECOND_US, seconds, score[0]))[0]
            return source, zones[z] if score[3, z] <= MOST_VIOLATIONS * rows else None, int(score[0, z]), rows

        for batch in batches:
            found, kind = [], batch.schema.field("source").type
            sources = batch.column("source").to_pylist()
            slot, least, most, base, n, rest = (np.asarray(batch.column(c)) for c in ("slot", "least", "most", "base", "n", "rest"))
            stretch = np.maximum(np.searchsorted(starts, slot, "right") - 1, 0)
            cuts = [k for k in range(1, len(sources)) if stretch[k] != stretch[k - 1] or not same(sources[k], sources[k - 1])]
            for a, b in zip([0, *cuts], [*cuts, len(sources)]):
                if a == b:
                    continue
                if rows and not same(sources[a], source):
                    found.append(best())
                    score[:], rows = 0, 0
                source = sources[a]
                rows += int(n[a:b].sum())
                if not zones:
                    continue
                if stretch[a] not in stretches:
                    stretches[stretch[a]] = np.unique(offsets[:, stretch[a]], return_inverse=True)
                used, of_zone = stretches[stretch[a]]  # each offset in use is scored once, whatever the number of its zones
                o = used[:, None]
                early, late = o < least[a:b], o > most[a:b]
                gap, sign = np.abs(o - base[a:b]) // SECOND_US, np.where(o > base[a:b], -1, 1)
                told = (np.where(early, 2, late) @ n[a:b], gap @ n[a:b], sign @ rest[a:b], (early | late) @ n[a:b])
                score += np.stack(told)[:, of_zone]
            yield table(found, kind)
        if rows:
            yield table([best()], kind)

    return run


def instants_beside(df: DataFrame, source: str, order: str, known_us: str, out: str, stretch: int = 100_000) -> DataFrame:
    """Add ``out``: of the rows of a source in ``order`` (a whole number), the last known instant up to a row, or else the
    next one. Where no ingestion time is stated, this stands for it in :func:`estimate_zones`: rows are written in about
    the order in which things happened. Looked for within stretches of ``stretch`` numbers, so that no source is one task."""
    (part,) = scratch(df, 1)
    x = df.withColumn(part, floor_div(F.col(order), stretch))
    w = Window.partitionBy(source, part).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    near = F.coalesce(F.last(known_us, ignorenulls=True).over(back), F.first(known_us, ignorenulls=True).over(ahead))
    return x.withColumn(out, near).drop(part)


def normalise_instants(
    df: DataFrame, source: str, text: str, stated_zone: str, out: str, day: str | None = None, ingested: str | None = None
) -> DataFrame:
    """Add BIGINT ``out``, the UTC instant of ``text`` in microseconds, or null where there is none.

    The zone that column ``stated_zone`` gives holds; where it is null or unknown and ``ingested``
    names a TIMESTAMP column, the zone is estimated per ``source`` from the zoneless rows of that
    source (see :func:`estimate_zones`). Rows of a null source keep a null zone. For the forms read
    see :func:`wayfare.functions.timestamps.read_instants`.
    """
    if ingested is None:
        return read_instants(df, text, out, stated_zone, day=day)
    unstated = ~F.coalesce(known_zone(F.col(stated_zone)), F.lit(False)) & F.col(source).isNotNull()
    if not df.where(unstated).limit(1).count():
        return read_instants(df, text, out, stated_zone, day=day)  # nothing to estimate
    wall, zone, us, est, read = scratch(df, 5)
    read_once = read_instants(df, text, read, stated_zone, day=day, wall=wall)
    missing = read_once.where(unstated)
    witnesses = missing.select(source, wall, F.unix_micros(F.col(ingested).cast("timestamp")).alias(us))
    guess = estimate_zones(witnesses, source, wall, us).select(F.col(source).alias(est), F.col("zone").alias(zone))
    filled = read_once.join(guess, F.col(source) == F.col(est), "left")
    late = F.when(F.col(wall).isNotNull() & F.col(read).isNull() & F.col(zone).isNotNull(), wall_to_utc_us(F.col(wall), F.coalesce(F.col(zone), F.lit("UTC"))))
    return filled.withColumn(out, F.coalesce(F.col(read), late)).drop(wall, zone, est, read)
