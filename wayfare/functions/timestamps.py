"""Reading timestamp texts of mixed form and zone as one UTC instant, JVM-side.

Anchored regular expressions, one per form, bring a text into a ``|``-separated record of
fixed fields; everything after that is integer arithmetic on those fields, so the whole
reading stays inside the JVM.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.columns import let, scratch

# Zone abbreviations and their offsets from UTC in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120,
    "EEST": 180, "MSK": 180, "IST": 330, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420,
    "MDT": -360, "PST": -480, "PDT": -420, "JST": 540,
}

# English month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_HALF = r"(?:\s*([AaPp])\.?[Mm]\.?)?"
_ZONE = r"\s*([Zz]|[+-]\d{2}(?::?\d{2})?|[A-Za-z][A-Za-z_]*(?:/[A-Za-z0-9_+\-]+)+|[A-Za-z]{2,5})?"
_WEEKDAY = r"(?:[A-Za-z]{3,9},?\s+)?"
# Fields of the record that every form is brought into; the numbers come first.
_NUMBERS = ("year", "month", "day", "first", "second_", "hour", "minute", "second")
_FIELDS = (*_NUMBERS, "month_name", "fraction", "half", "zone", "count")
# Each form and the record made of its groups.
_ISO = (r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})[T\s]\s*" + _CLOCK + _ZONE, "=|$1|$2|$3|||$4|$5|$6||$7||$8||")
_COMPACT = (r"(\d{4})(\d{2})(\d{2})[T\s]?(\d{2})(\d{2})(\d{2})(?:[.,]?(\d{3}))?" + _ZONE, "=|$1|$2|$3|||$4|$5|$6||$7||$8||")
_COUNT = (r"(\d{9,10}|\d{12,13}|\d{15,16})", "=|||||||||||||$1|")
_NUMERIC = (r"(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})(?:[T,]|\s)\s*" + _CLOCK + _HALF + _ZONE, "=|$3|||$1|$2|$4|$5|$6||$7|$8|$9||")
_DAY_NAME = (_WEEKDAY + r"(\d{1,2})[\s\-]([A-Za-z]{3,9})\.?[\s\-](\d{4}),?\s+" + _CLOCK + _HALF + _ZONE, "=|$3||$1|||$4|$5|$6|$2|$7|$8|$9||")
_NAME_DAY = (_WEEKDAY + r"([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4}),?\s+" + _CLOCK + _HALF + _ZONE, "=|$3||$2|||$4|$5|$6|$1|$7|$8|$9||")


def _record(t: Column) -> Column:
    """The record of a trimmed text, beginning with ``=|``; any other text as it is. A look at one or two
    characters tells which forms are worth trying."""

    def tried(*forms: tuple[str, str]) -> Column:
        e = t
        for form, fields in forms:
            e = F.regexp_replace(e, f"^(?:{form})$", fields)
        return e

    second, third, fifth = (F.substring(t, k, 1) for k in (2, 3, 5))
    return (
        F.when(fifth.isin("-", "/") & third.between("0", "9"), tried(_ISO))
        .when(fifth.between("0", "9") & third.between("0", "9"), tried(_COMPACT, _COUNT))
        .when(third.isin("/", ".", "-") | second.isin("/", ".", "-"), tried(_NUMERIC, _DAY_NAME))
        .otherwise(tried(_DAY_NAME, _NAME_DAY))
    )


@lru_cache(maxsize=1)
def zone_names() -> tuple[str, ...]:
    """The names of all zones the JVM knows."""
    jvm = SparkSession.active().sparkContext._jvm
    return tuple(sorted(str(z) for z in jvm.java.time.ZoneId.getAvailableZoneIds()))


def known_zone(zone: Column) -> Column:
    """True where ``zone`` names a zone the JVM knows."""
    return zone.isin(*zone_names())


def _lookup(table: dict[str, int], key: Column) -> Column:
    """The value of ``key`` in a small fixed table, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def digits_or_null(c: Column, kind: str = "int", most: int = 9) -> Column:
    """A cast that is only tried on 1 to ``most`` digits: a failed ``try_cast`` costs an exception per row."""
    return F.when(c.rlike(rf"^\d{{1,{most}}}$"), c).cast(kind)


def civil_days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01, or null where no such date exists."""
    first = F.make_date(F.greatest(year, F.lit(1)), F.least(F.greatest(month, F.lit(1)), F.lit(12)), F.lit(1))
    good = (year >= 1) & month.between(1, 12) & (day >= 1) & (day <= F.dayofmonth(F.last_day(first)))
    return F.when(good, F.unix_date(first) + day - 1)


def wall_to_utc_us(wall_us: Column, zone: Column) -> Column:
    """Wall clock microseconds in a named zone as microseconds since 1970: of a time that
    occurs twice the first, a skipped time moved forward by the skip."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall_us), zone))


def compact_utc_us(text: Column) -> Column:
    """``yyyyMMddHHmmssSSS`` (blank padding allowed), in UTC, as microseconds; null for anything else."""
    digits = F.when(F.trim(text).rlike(r"^\d{17}$"), F.trim(text))
    marked = F.concat(F.substring(digits, 1, 14), F.lit("."), F.substring(digits, 15, 3), F.lit("Z"))
    return F.unix_micros(F.try_to_timestamp(marked, F.lit("yyyyMMddHHmmss.SSSX")))


def read_instants(
    df: DataFrame, text: str, out: str, zone: str, day: str | None = None, wall: str | None = None
) -> DataFrame:
    """Add BIGINT ``out``: the instant that string column ``text`` denotes, in microseconds since 1970.

    * An offset, zone name, abbreviation or ``Z`` in the text decides; a text without zone is
      wall clock in the zone named by column ``zone``.
    * Digits only: 14 or 17 digits are wall clock from year to second or millisecond; 9-10,
      12-13 and 15-16 digits count seconds, milliseconds and microseconds since 1970.
    * Where day and month could be exchanged, the reading equal to ``day`` (yyyyMMdd) wins;
      without such a column or match the day comes first.
    * Null for null, empty and blank texts, texts of no known form, dates or times that do not
      exist, unknown zone names, and zoneless texts whose ``zone`` is null or unknown.
    * Fractions beyond microseconds are cut off. Other columns are kept, whatever their names.

    With ``wall`` also a BIGINT column of that name: the zoneless wall clock reading (null where
    the text carries its own zone or is a count), from which a missing zone can be estimated.
    """
    rec, num, wall_, got, wall_got = scratch(df, 5, also=(out, wall))
    df = df.withColumn(rec, F.regexp_replace(F.col(text), r"^\s+|\s+$", ""))
    df = df.withColumn(rec, _record(F.col(rec)))
    df = df.withColumn(rec, F.when(F.col(rec).startswith("=|"), F.split(F.col(rec), r"\|")))
    df = df.withColumn(num, F.transform(F.slice(rec, 2, len(_NUMBERS)), lambda x: F.nullif(x, F.lit("")).cast("int")))
    at = lambda name: 1 + _FIELDS.index(name)
    told_month = told_day = F.lit(None).cast("int")
    if day is not None:
        told_month = digits_or_null(F.substring(F.col(day), 5, 2))
        told_day = digits_or_null(F.substring(F.col(day), 7, 2))

    no = _NUMBERS.index

    def wall_us(n: Column) -> Column:
        """The wall clock time of the record's numbers, in microseconds, or null if there is no such time."""
        a, b = n[no("first")], n[no("second_")]
        # Exchangeable day and month: month first if that is the day told, or if the second cannot be a month.
        month_first = F.coalesce((told_month == a) & (told_day == b), F.lit(False)) | (b > 12)
        name = F.lower(F.substring(F.col(rec)[at("month_name")], 1, 3))
        month_name = _lookup({m: k + 1 for k, m in enumerate(MONTHS)}, name)
        date = F.struct(
            n[no("year")].alias("y"),
            F.coalesce(n[no("month")], F.when(month_first, a).otherwise(b), month_name).alias("m"),
            F.coalesce(n[no("day")], F.when(month_first, b).otherwise(a)).alias("d"),
        )
        days = let(date, lambda x: civil_days(x["y"], x["m"], x["d"]))
        half = F.upper(F.col(rec)[at("half")])
        hour = F.when(half == "", n[no("hour")]).otherwise(n[no("hour")] % 12 + F.when(half == "P", 12).otherwise(0))
        second = F.coalesce(n[no("second")], F.lit(0))
        good = (n[no("hour")] < 24) & (n[no("minute")] < 60) & (second < 60) & ((half == "") | n[no("hour")].between(1, 12))
        fraction = F.rpad(F.substring(F.col(rec)[at("fraction")], 1, 6), 6, "0").cast("long")
        return F.when(good, ((days.cast("long") * 24 + hour) * 60 + n[no("minute")]) * 60_000_000 + second * 1_000_000 + fraction)

    df = df.withColumn(wall_, let(F.col(num), wall_us))

    def with_zone(z: Column) -> Column:
        """The instant of a wall clock time with zone text ``z``, empty where none is written."""
        offset = F.regexp_replace(z, ":", "")
        hours, minutes = digits_or_null(F.substring(offset, 2, 2)), F.coalesce(digits_or_null(F.substring(offset, 4, 2)), F.lit(0))
        signed = F.when((hours <= 18) & (minutes < 60), (hours * 60 + minutes) * F.when(z.startswith("-"), -1).otherwise(1))
        fixed = F.when(z.rlike("^[+-]"), signed).otherwise(_lookup(ABBREVIATIONS, F.upper(z)))
        named = F.when(z == "", F.col(zone)).when(z.contains("/"), z)
        return F.when(
            (z == "") | z.contains("/"), let(F.when(known_zone(named), named), lambda k: F.when(k.isNotNull(), wall_to_utc_us(F.col(wall_), F.coalesce(k, F.lit("UTC")))))
        ).otherwise(F.col(wall_) - fixed.cast("long") * 60_000_000)

    def counted(c: Column) -> Column:
        n = digits_or_null(c, "long", 18)
        return F.when(F.length(c) <= 10, n * 1_000_000).when(F.length(c) <= 13, n * 1000).otherwise(n)

    count, written = F.col(rec)[at("count")], F.col(rec)[at("zone")]
    instant = F.when(count != "", let(count, counted)).otherwise(let(written, with_zone))
    read = F.struct(instant.alias(got), F.when((written == "") & (count == ""), F.col(wall_)).alias(wall_got))
    # The one-row generator is a barrier: filters on the instant, pushed below it, would evaluate the whole reading again.
    df = df.select("*", F.inline(F.array(read))).drop(rec, num, wall_)
    df = df.withColumn(out, F.col(got))
    if wall is not None:
        df = df.withColumn(wall, F.col(wall_got))
    return df.drop(got, wall_got)
