"""The last known value carried forward: along a date spine, or to the days of another table (an as-of join).

Rows are one per key and day. A key's days are cut into months. Within a month values are carried by a window of at most
31 rows, whatever the length of the history; from month to month travels one row, the month's last known values. So the
largest group is a key's months, not its days, and no pairs of rows are made.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.operators.reads import as_day

_BLOCK = "_block"
_KNOWN = "_known"


def carry_forward(rows: DataFrame, keys: list[str], day: str, values: list[str]) -> DataFrame:
    """`rows` with `values` of the latest row on or before each, per key, of which any of them is not NULL.

    `rows` holds one row per key and day. The values travel together: those of one row are never mixed with another's.
    Rows before the first known values keep NULLs. NULLs in `keys` are keys like any other; rows without a day keep
    what they have.
    """
    known = F.lit(False)
    for name in values:
        known = known | F.col(name).isNotNull()
    marked = rows.withColumns({
        _BLOCK: F.trunc(day, "month"), _KNOWN: F.when(known & F.col(day).isNotNull(), F.struct(*values))})
    month = [*keys, _BLOCK]
    # One row a key and month, combined within tasks; only then are a key's rows brought together.
    ends = marked.filter(F.col(_BLOCK).isNotNull()).groupBy(*month).agg(
        F.max_by(_KNOWN, F.when(F.col(_KNOWN).isNotNull(), F.col(day))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("_end", ignorenulls=True).over(earlier).alias("_before")
    brought = ends.select(*month, before).select(*[F.col(k).alias(f"_of_{k}") for k in month], "_before")
    so_far = Window.partitionBy(*month).orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = marked.withColumn("_within", F.when(F.col(day).isNotNull(), F.last(_KNOWN, ignorenulls=True).over(so_far)))
    same = F.lit(True)
    for name in month:
        same = same & F.col(name).eqNullSafe(F.col(f"_of_{name}"))
    found = within.join(brought, same, "left").withColumn("_found", F.coalesce("_within", "_before"))
    return found.select(*[F.coalesce(F.col("_found")[name], F.col(name)).alias(name) if name in values else F.col(name)
                          for name in rows.columns])


def day_spine(rows: DataFrame, keys: list[str], day: str, until: dt.date | str | Column | None = None) -> DataFrame:
    """Every day of each key from its first in `rows` to `until`, or to the last day of all keys.

    A key without a day has no spine, nor has one whose first day lies after `until`.
    """
    bounds = rows.filter(F.col(day).isNotNull()).groupBy(*keys).agg(F.min(day).alias("_first"))
    if until is None:
        # One value; with no rows there is no spine to end.
        last = rows.agg(F.max(day)).first()[0]
        end = F.lit(last).cast("date")
    else:
        end = until if isinstance(until, Column) else F.lit(as_day(until))
    days = F.explode(F.sequence("_first", end.cast("date"))).alias(day)
    return bounds.filter(F.col("_first") <= end).select(*keys, days)
