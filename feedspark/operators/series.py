"""Scans over ordered series of any length.

A window over one key puts the whole key in one task. Here the order is cut at quantiles of all rows, so that a key's rows fall in slices
that are windows of their own; what a slice hands on to the next one is a row of a summary, and only summaries (a row for each key and
slice) meet in a window by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLICES = 64


def _at_least(x: Column, bounds: list, low: int = 0) -> Column:
    """How many of the ordered bounds lie below x, by halving."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(x > F.lit(bounds[mid]), _at_least(x, bounds[mid + 1 :], low + mid + 1)).otherwise(_at_least(x, bounds[:mid], low))


def sliced(rows: DataFrame, order: str, slices: int = SLICES, name: str = "_slice") -> DataFrame:
    """rows with the number of their slice. order: a number, date or timestamp; nulls go to the first slice. Rows of equal order share a slice."""
    bounds = rows.agg(F.percentile_approx(order, [i / slices for i in range(1, slices)], 1_000)).first()[0] or []
    return rows.withColumn(name, _at_least(F.col(order), sorted(set(bounds))))


def before(keys: list[str], name: str = "_slice"):
    """The window over a summary's earlier slices of a key."""
    return Window.partitionBy(*keys).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)


def same(keys: list[str]) -> list[Column]:
    """A join of rows with a summary whose keys are named with a trailing _; null keys meet."""
    return [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
