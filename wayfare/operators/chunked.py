"""Ordered computations per key that survive a hot key.

A plain window over a key sorts that key's rows in one task. Here rows are windowed per
(key, chunk), a chunk being a stretch of the order such as a day; each chunk then learns what
it needs from the chunks around it from a table of one row per (key, chunk). A key that holds
a third of all rows is thereby spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.functions.columns import floor_div, scratch

DAY_US = 86_400_000_000


def chunk_of(us: Column, width_us: int = DAY_US) -> Column:
    """The number of the stretch of ``width_us`` microseconds that holds ``us``."""
    return floor_div(us, width_us)


def with_neighbours(
    df: DataFrame, keys: list[str], chunk: str, order: list[str], columns: list[str], before: str, after: str
) -> DataFrame:
    """Add struct columns ``before`` and ``after``: ``columns`` of the previous and next row of the
    same ``keys`` in ``order``, null at the ends. ``chunk`` must not decrease along ``order``."""
    near = Window.partitionBy(*keys, chunk).orderBy(*order)
    value = F.struct(*columns)
    ends = scratch(df, 2)
    rows = df.withColumns({before: F.lag(value).over(near), after: F.lead(value).over(near)})
    summary = rows.groupBy(*keys, chunk).agg(
        F.max(F.when(F.col(before).isNull(), value)).alias(ends[0]),
        F.max(F.when(F.col(after).isNull(), value)).alias(ends[1]),
    )
    far = Window.partitionBy(*keys).orderBy(chunk)
    carried = summary.select(
        *keys, chunk, F.lag(ends[1]).over(far).alias(ends[0]), F.lead(ends[0]).over(far).alias(ends[1])
    )
    return (
        rows.join(carried, [*keys, chunk])
        .withColumns({before: F.coalesce(before, ends[0]), after: F.coalesce(after, ends[1])})
        .drop(*ends)
    )


def with_running_sums(
    df: DataFrame, keys: list[str], chunk: str, order: list[str], sums: dict[str, Column]
) -> DataFrame:
    """Add, per name in ``sums``, the sum of its expression over the rows of the same ``keys`` up to
    and including this one in ``order``. ``order`` must be a total order within the keys."""
    near = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    far = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = scratch(df, len(sums))
    rows = df.withColumns({name: F.sum(e).over(near) for name, e in sums.items()})
    totals = rows.groupBy(*keys, chunk).agg(*[F.max_by(n, F.struct(*order)).alias(c) for n, c in zip(sums, carry)])
    carried = totals.select(*keys, chunk, *[F.coalesce(F.sum(c).over(far), F.lit(0)).alias(c) for c in carry])
    rows = rows.join(carried, [*keys, chunk])
    return rows.withColumns({n: F.col(n) + F.col(c) for n, c in zip(sums, carry)}).drop(*carry)


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each key of batches sorted by key, for ``mapInArrow`` after a sort within partitions: many small groups
    cost no call each. One key is held at a time."""
    waiting: list[pa.RecordBatch] = []
    key: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            codes = np.asarray(c.dictionary_encode().indices) if pa.types.is_string(c.type) else np.asarray(c)
            change[1:] |= codes[1:] != codes[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            mine = tuple(c[a].as_py() for c in columns)
            if key is not None and mine != key:
                yield key, pa.Table.from_batches(waiting)
                waiting = []
            key = mine
            waiting.append(batch.slice(a, b - a))
    if waiting:
        yield key, pa.Table.from_batches(waiting)
