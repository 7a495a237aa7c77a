"""Analytics over the daily total-asset overview, one series of days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions import labels, limits
from folioframe.operators import rank, reads
from folioframe.plans.portfolio import changes, moving_trend

_HISTORY = (
    "snap_date", "snapshot_at", "domestic_eval_amt_krw", "overseas_stock_eval_amt_krw",
    "overseas_cash_amt_krw", "overseas_total_asset_amt_krw", "total_eval_amt_krw",
)
_ALLOCATION = (
    "snap_date", "domestic_pct", "overseas_pct", "overseas_stock_pct", "overseas_cash_pct",
    "domestic_direct_amt_krw", "overseas_direct_amt_krw", "overseas_indirect_amt_krw", "cash_amt_krw",
    "unknown_amt_krw", "total_eval_amt_krw",
)


def history(daily: DataFrame, days: int = 30, limit: int | None = None, as_of: reads.Day | None = None) -> DataFrame:
    """Asset totals per day, newest first: all of the lookback, or the first `limit`."""
    rows = reads.lookback(daily, as_of, days).select(*_HISTORY)
    return rank.newest(rows, limits.row_limit(limit), "snap_date")


def daily_change(daily: DataFrame, days: int = 14) -> DataFrame:
    """Day-to-day change of total assets: the latest `days` rows."""
    rows = changes(daily.select("snap_date", "total_eval_amt_krw"), "total_eval_amt_krw", [])
    return rank.newest(rows, limits.lookback(days, 2), "snap_date")


def trend(daily: DataFrame, short_window: int = 7, long_window: int = 30, lookback_days: int = 90,
          as_of: reads.Day | None = None, names: labels.TrendLabels = labels.TrendLabels()) -> DataFrame:
    """Moving averages of total assets, newest first."""
    short, long, days = limits.trend_windows(short_window, long_window, lookback_days)
    rows = reads.lookback(daily, as_of, days)
    return moving_trend(rows, "total_eval_amt_krw", [], short, long, names).orderBy(F.desc("snap_date"))


def allocation_history(daily: DataFrame, days: int = 30, as_of: reads.Day | None = None) -> DataFrame:
    """Allocation percentages and exposure amounts per day, newest first."""
    return reads.lookback(daily, as_of, days).select(*_ALLOCATION).orderBy(F.desc("snap_date"))
