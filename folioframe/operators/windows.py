"""Windows over daily series.

They run on curated rows, one per key and day, so a partition holds days, not observations: ten years are
3,650 rows however often an account was observed. The keys must be unique per day, as the merges and the
daily curation leave them.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def series(keys: list[str], order: str) -> WindowSpec:
    """One window per key; without keys one series of days, of a length bounded by the calendar."""
    return (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(order)


def rolling(keys: list[str], order: str, rows: int) -> WindowSpec:
    return series(keys, order).rowsBetween(1 - rows, Window.currentRow)


def previous(column: str, keys: list[str], order: str) -> Column:
    return F.lag(column).over(series(keys, order))


def rolling_count(column: str, window: WindowSpec) -> Column:
    return F.count(column).over(window)


def rolling_mean(column: str, window: WindowSpec) -> Column:
    return F.avg(column).over(window)


def rolling_std(column: str, window: WindowSpec) -> Column:
    return F.stddev_samp(column).over(window)
