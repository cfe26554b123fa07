"""The reading of timestamp texts as SQL of another engine, to compare queries on instants with."""

from __future__ import annotations

from wayfare.functions.timestamps import ABBREVIATIONS, MONTHS

_Z = r"\s*([Zz]|[+-]\d{2}:?(?:\d{2})?|[A-Za-z_]+(?:/[A-Za-z0-9_+\-]+)+|[A-Za-z]{2,5})?"
_C = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_H = r"(?:\s*([AaPp])\.?[Mm]\.?)?"
# Each form's pattern and the order of its groups as year|month|day|hour|minute|second|fraction|half|zone.
_FORMS = [
    (r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})[T\s]\s*" + _C + _Z, r"\1|\2|\3|\4|\5|\6|\7||\8"),
    (r"(\d{4})(\d{2})(\d{2})[T\s]?(\d{2})(\d{2})(\d{2})[.,]?(\d{3})?" + _Z, r"\1|\2|\3|\4|\5|\6|\7||\8"),
    (r"(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})[T,\s]\s*" + _C + _H + _Z, r"\3|?\2|\1|\4|\5|\6|\7|\8|\9"),
    (r"(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})[\s\-]([A-Za-z]{3})[a-z]*\.?[\s\-](\d{4}),?\s+" + _C + _H + _Z, r"\3|\2|\1|\4|\5|\6|\7|\8|\9"),
    (r"(?:[A-Za-z]{3,9},?\s+)?([A-Za-z]{3})[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4}),?\s+" + _C + _H + _Z, r"\3|\1|\2|\4|\5|\6|\7|\8|\9"),
]


def sql_instants(out: str, source: str, text: str, zone: str, day: str = "NULL", us: str = "instant_us") -> str:
    """CTEs that end in ``out``: the rows of ``source`` (SQL) with the BIGINT column ``us``."""
    record = " ".join(f"WHEN regexp_full_match(s, '{p}') THEN regexp_replace(s, '^{p}$', '{g}')" for p, g in _FORMS)
    month = "CASE " + " ".join(f"WHEN lower(f[2]) = '{m}' THEN {k + 1}" for k, m in enumerate(MONTHS)) + " ELSE try_cast(ltrim(f[2], '?') AS int) END"
    minutes = "CASE upper(z) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ABBREVIATIONS.items()) + " END"
    swap = f"(f[2] LIKE '?%' AND (m > 12 OR (m = try_cast(substr({day}, 7, 2) AS int) AND d = try_cast(substr({day}, 5, 2) AS int))))"
    return f"""{out}_a AS (SELECT *, regexp_replace({text}, '^\\s+|\\s+$', '', 'g') AS s FROM ({source})),
{out}_b AS (SELECT *, CASE WHEN regexp_full_match(s, '\\d{{9,10}}|\\d{{12,13}}|\\d{{15,16}}') THEN NULL {record} END AS r,
  CASE WHEN regexp_full_match(s, '\\d{{9,10}}') THEN try_cast(s AS bigint) * 1000000 WHEN regexp_full_match(s, '\\d{{12,13}}') THEN try_cast(s AS bigint) * 1000 WHEN regexp_full_match(s, '\\d{{15,16}}') THEN try_cast(s AS bigint) END AS counted FROM {out}_a),
{out}_c AS (SELECT *, string_split(r, '|') AS f FROM {out}_b),
{out}_d AS (SELECT *, {month} AS m, try_cast(f[3] AS int) AS d, try_cast(f[4] AS int) AS hh, f[9] AS z FROM {out}_c),
{out}_e AS (SELECT *, CASE WHEN {swap} THEN d ELSE m END AS mo_, CASE WHEN {swap} THEN m ELSE d END AS dy_, CASE WHEN f[8] = '' THEN hh WHEN hh BETWEEN 1 AND 12 THEN hh % 12 + CASE WHEN upper(f[8]) = 'P' THEN 12 ELSE 0 END END AS h_ FROM {out}_d),
{out}_f AS (SELECT *, CASE WHEN h_ < 24 AND f[5] < '60' AND f[6] < '60' AND f[1] <> '0000' THEN try_cast(f[1] || '-' || lpad(mo_::varchar, 2, '0') || '-' || lpad(dy_::varchar, 2, '0') || ' ' || lpad(h_::varchar, 2, '0') || ':' || f[5] || ':' || CASE WHEN f[6] = '' THEN '00' ELSE f[6] END || '.' || rpad(left(f[7], 6), 6, '0') AS timestamp) END AS wall,
  CASE WHEN z = '' THEN {zone} WHEN z LIKE '%/%' THEN z END AS named FROM {out}_e),
{out}_g AS (SELECT *, CASE WHEN named IN (SELECT name FROM pg_timezone_names()) THEN epoch_us(timezone(named, wall)) END AS u FROM {out}_f),
{out} AS (SELECT * EXCLUDE (s, r, f, m, d, hh, z, mo_, dy_, h_, u, wall, named, counted), CASE WHEN r IS NULL THEN counted WHEN z = '' OR z LIKE '%/%' THEN
  CASE WHEN timezone(named, to_timestamp((u - 3600000000) / 1000000.0)) = date_trunc('second', wall) + to_microseconds(epoch_us(wall) % 1000000) THEN u - 3600000000 ELSE u END
  WHEN regexp_matches(z, '^[+-]') THEN epoch_us(wall) - (CASE WHEN z[1] = '-' THEN -60000000 ELSE 60000000 END) * (try_cast(substr(z, 2, 2) AS bigint) * 60 + coalesce(try_cast(nullif(right(replace(z[4:], ':', ''), 2), '') AS bigint), 0))
  ELSE epoch_us(wall) - ({minutes})::bigint * 60000000 END AS {us} FROM {out}_g)"""


SQL_LOCATIONS = sql_instants("loc", "SELECT l.*, c.time_zone FROM locationeventpertime l LEFT JOIN citizen c ON c.citizen_id = l.user_id", "timestamp", "time_zone", "day")
SQL_TRIPS = sql_instants("mv", "SELECT t.*, c.time_zone FROM trip t LEFT JOIN citizen c USING (citizen_id)", "start_timestamp", "time_zone", us="start_us")
SQL_SHAKES = "acc AS (SELECT *, CASE WHEN length(trim(timestamp)) = 17 THEN epoch_us(try_strptime(trim(timestamp), '%Y%m%d%H%M%S%g')) END AS instant_us FROM accelerometerevent)"
