"""Column naming helpers that keep operators safe from clashing names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scratch(df: DataFrame, n: int, stem: str = "__w", also: tuple[str | None, ...] = ()) -> list[str]:
    """``n`` column names that neither ``df`` nor ``also`` has, compared without regard to case."""
    taken, names, k = {c.lower() for c in (*df.columns, *also) if c}, [], 0
    while len(names) < n:
        if f"{stem}{k}" not in taken:
            names.append(f"{stem}{k}")
        k += 1
    return names


def floor_div(a: Column, b: int) -> Column:
    """Whole quotient of BIGINT ``a`` and ``b``, rounded down; exact where a plain ``/`` goes through DOUBLE."""
    return ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once. A lambda body is evaluated node by node instead of
    being pasted into the stage's one generated method, which would outgrow the JIT compiler."""
    return F.transform(F.array(value), body)[0]
