"""Sorts, limits and top-n lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, limit: int | None, day: str, *ties: str | Column) -> DataFrame:
    """Latest `limit` rows, of which Spark keeps only that many per task; without a limit all, sorted."""
    rows = df.orderBy(F.desc(day), *ties)
    return rows if limit is None else rows.limit(limit)


def newest_per_key(df: DataFrame, keys: list[str], limit: int | None, day: str) -> DataFrame:
    """Latest `limit` rows of each key, all without a limit."""
    return df if limit is None else first_per_key(df, keys, [F.desc(day)], limit)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """First `limit` rows of each key. Spark cuts each task's rows to the limit before the shuffle, so a
    large key sends at most `limit` rows per task."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")


def largest_first(df: DataFrame, score: Column, limit: int | None, *ties: str) -> DataFrame:
    """Highest scores first, rows without a score last; all rows without a limit."""
    rows = df.orderBy(score.desc_nulls_last(), *ties)
    return rows if limit is None else rows.limit(limit)


def top_with_other(rows: DataFrame, keys: list[str], value: str, label: str, n: int, other: str,
                   ties: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    """The `n` largest values of each key and one row for the rest, if there is any.

    Gives keys, `place` (1..n+1), `label`, `value` and the `extra` columns, which the rest has none of. The rest is the key's total less its top, so no key is
    ever ranked whole: the top is cut per task, the totals are partial sums. NULL values count as 0.
    """
    amount = F.coalesce(F.col(value), F.lit(0))
    order = Window.partitionBy(*keys).orderBy(amount.desc(), *[F.asc_nulls_last(tie) for tie in ties])
    top = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    totals = rows.groupBy(*keys).agg(F.sum(amount).alias("_all"), F.count(F.lit(1)).alias("_rows"))
    sums = top.groupBy(*keys).agg(F.sum(amount).alias("_top"))
    rest = totals.filter(F.col("_rows") > n).join(sums, keys)
    listed = top.select(*keys, "place", F.col(label).alias("label"), F.col(value).alias("value"), *extra)
    remainder = rest.select(
        *keys, F.lit(n + 1).alias("place"), F.lit(other).alias("label"),
        (F.col("_all") - F.col("_top")).alias("value"),
    )
    return listed.unionByName(remainder, allowMissingColumns=True)
