"""Returns kept by day, and their mergeable moments by month, so that statistics of any lookback read few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions import limits, numbers
from folioframe.operators import reads, windows

MONTH = reads.MONTH


def kept_returns(daily: DataFrame) -> DataFrame:
    """account_id, snap_date, previous_date, return_pct (unrounded) and month of every valued day but each account's
    first. To be stored by month; a later run needs the account's last valued day beside the new ones."""
    days = daily.filter(F.col("total_eval_amt").isNotNull()).groupBy("account_id", "snap_date").agg(
        F.sum("total_eval_amt").alias("total_eval_amt"))
    series = days.select(
        "account_id", "snap_date", "total_eval_amt",
        windows.previous("total_eval_amt", ["account_id"], "snap_date").alias("_before"),
        windows.previous("snap_date", ["account_id"], "snap_date").alias("previous_date"))
    return series.filter(F.col("previous_date").isNotNull()).select(
        "account_id", "snap_date", "previous_date",
        numbers.change_pct(F.col("total_eval_amt"), F.col("_before")).alias("return_pct"),
        F.date_format("snap_date", "yyyy-MM").alias(MONTH))


def kept_moments(returns: DataFrame) -> DataFrame:
    """Per account and month: how many returns, their mean and sum of squared deviations, and the first and last of
    the days that they look back to."""
    return returns.groupBy("account_id", MONTH).agg(
        F.count("return_pct").alias("n"), F.coalesce(F.avg("return_pct"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop("return_pct") * F.count("return_pct"), F.lit(0.0)).alias("squares"),
        F.min("previous_date").alias("from_date"), F.max("previous_date").alias("to_date"))


def merged(moments: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean and std (of a sample) of all that the rows' n, mean and squares stand for."""
    sums = moments.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("_sum"),
        F.sum(F.col("squares") + F.col("n") * F.col("mean") * F.col("mean")).alias("_all"))
    mean = F.col("_sum") / F.nullif(F.col("n"), F.lit(0))
    # What is left of equal values by rounding is no spread.
    rest = F.col("_all") - F.col("_sum") * mean
    spread = F.when(rest > F.col("_all") * 1e-13, rest).otherwise(F.lit(0.0))
    return sums.select(*keys, "n", mean.alias("mean"), F.when(F.col("n") > 1, F.sqrt(spread / (F.col("n") - 1))).alias("std"))


def return_statistics(returns: DataFrame, moments: DataFrame, as_of: reads.Day | None, lookback_days: int) -> DataFrame:
    """account_id, n, mean and std of the returns in a lookback, whose first valued day has none.

    Months that lie in the lookback with all they look back to are merged from their moments. Of the others only the days
    are read, and only of the months that some account needs: at most one month an account is cut.
    """
    first = reads.since(as_of, limits.lookback(lookback_days, 2))
    whole = moments.filter(F.col("from_date") >= first)
    cut = moments.filter((F.col("from_date") < first) & (F.col("to_date") >= first))
    # Months, not accounts: a handful of values that prunes the stored days.
    months = [row[0] for row in cut.select(MONTH).distinct().collect()]
    edge = returns.filter(F.col(MONTH).isin(months) & (F.col("previous_date") >= first)).join(
        cut.select("account_id", MONTH), ["account_id", MONTH], "left_semi")
    single = edge.filter(F.col("return_pct").isNotNull()).select(
        "account_id", F.lit(1).cast("bigint").alias("n"), F.col("return_pct").alias("mean"), F.lit(0.0).alias("squares"))
    return merged(whole.select("account_id", "n", "mean", "squares").unionByName(single), ["account_id"]).filter("n > 0")


def scored_returns(returns: DataFrame, moments: DataFrame, as_of: reads.Day | None, lookback_days: int,
                   scored_days: int) -> DataFrame:
    """The returns of the last `scored_days` days against their account's statistics in the lookback: account_id,
    snap_date, return_pct and z_score, both rounded. Days before those are not read."""
    recent = reads.since(as_of, limits.lookback(scored_days))
    first = reads.since(as_of, limits.lookback(lookback_days, 2))
    days = returns.filter((F.col(MONTH) >= F.date_format(recent, "yyyy-MM")) & (F.col("snap_date") >= recent)
                          & (F.col("previous_date") >= first))
    known = days.join(return_statistics(returns, moments, as_of, lookback_days), "account_id")
    return known.select("account_id", "snap_date", F.round("return_pct", 2).alias("return_pct"),
                        F.round(numbers.z_score(F.col("return_pct"), F.col("mean"), F.col("std")), 2).alias("z_score"))
