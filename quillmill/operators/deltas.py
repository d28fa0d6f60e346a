"""Differences of cumulative counters and values carried forward in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def from_cumulative(df: DataFrame, keys: list[str], order: list[str], counters: list[str]) -> DataFrame:
    """WIN-07: snapshots to differences from the one before, at least 0; the first of a key stays whole."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"{c}_delta": F.greatest(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)), F.lit(0)) for c in counters})


def last_or_delta(df: DataFrame, keys: list[str], order: list[str], total: str, last: str) -> DataFrame:
    """WIN-08: the reported last usage where the total advanced, else the difference of totals (at least 0)."""
    before = F.coalesce(F.lag(total).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(0))
    advanced = F.greatest(F.col(total) - before, F.lit(0))
    return df.withColumn("used", F.when((F.col(total) > before) & F.col(last).isNotNull(), F.col(last)).otherwise(advanced))


def carried(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, Column]) -> DataFrame:
    """STATE-01, STATE-03: the last value seen up to each row.

    columns: name to a value that is null where the row says nothing. A row that clears a value gives the
    text '\\0', which is carried like any other and shown as null.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({n: F.nullif(F.last(v, ignorenulls=True).over(w), F.lit("\0")) if n.startswith("state_") else F.last(v, ignorenulls=True).over(w) for n, v in columns.items()})
