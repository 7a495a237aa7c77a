"""Analytics over the daily value of accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import labels, limits, numbers
from folioframe.operators import rank, reads, windows
from folioframe.operators.carry import carry_forward
from folioframe.operators.curate import time_rank

ALL = "ALL"
_SUMMARY = ("account_type", "snap_date", "snapshot_at", "total_eval_amt")


def _of_account(daily: DataFrame, account_id: str) -> DataFrame:
    return daily.filter(F.col("account_id") == account_id) if account_id else daily


def latest_summary(daily: DataFrame, account_id: str = "", lookback_days: int = 30,
                   as_of: reads.Day | None = None) -> DataFrame:
    """Latest valued day of each account, sorted by type and account."""
    rows = reads.lookback(_of_account(daily, account_id), as_of, lookback_days)
    return _latest(rows.filter(F.col("total_eval_amt").isNotNull()), "account_type")


def latest_summary_of_snapshots(snapshots: DataFrame, account_id: str = "", lookback_days: int = 30,
                                as_of: reads.Day | None = None, tie_breaker: str = "id") -> DataFrame:
    """The same straight from snapshots: the latest row of the latest day is the latest row, so one aggregate
    does for daily curation and ranking."""
    day = F.col("snapshot_at").cast("date")
    rows = _of_account(snapshots, account_id).filter(F.col("total_eval_amt").isNotNull()).withColumn("snap_date", day)
    return _latest(reads.lookback(rows, as_of, lookback_days), tie_breaker)


def _latest(rows: DataFrame, tie_breaker: str) -> DataFrame:
    last = F.max_by(F.struct(*_SUMMARY), time_rank("snapshot_at", tie_breaker)).alias("_last")
    return rows.groupBy("account_id").agg(last).select("account_id", "_last.*").orderBy(
        "account_type", "account_id"
    )


def totals_by_type(summary: DataFrame) -> DataFrame:
    """Account count and value per account type, and over all of them in the row whose type is `ALL`."""
    kind = F.coalesce("account_type", F.lit("unknown"))
    rows = summary.withColumn("account_type", kind).rollup("account_type").agg(
        F.grouping("account_type").alias("_all"),
        F.count(F.lit(1)).alias("account_count"),
        F.coalesce(F.sum("total_eval_amt"), F.lit(0)).alias("total_eval_amt"),
        F.max("snapshot_at").alias("latest_snapshot_at"),
    )
    return rows.select(
        F.when(F.col("_all") == 1, ALL).otherwise(F.col("account_type")).alias("account_type"),
        "account_count", "total_eval_amt", "latest_snapshot_at",
    )


def daily_totals(daily: DataFrame, account_id: str = "") -> DataFrame:
    """Value and number of accounts per day. An account without a snapshot that day is not carried forward."""
    owner = F.lit(account_id or ALL).alias("account_id")
    return _of_account(daily, account_id).groupBy(owner, "snap_date").agg(
        F.sum("total_eval_amt").alias("total_eval_amt"),
        F.count_distinct("account_id").alias("account_count"),
    )


def changes(rows: DataFrame, value: str, keys: list[str], day: str = "snap_date") -> DataFrame:
    """Previous value, change and percent change along each series."""
    before = f"prev_{value}"
    return rows.withColumn(before, windows.previous(value, keys, day)).withColumns({
        "change_amt": F.col(value) - F.col(before),
        "change_pct": F.round(numbers.change_pct(F.col(value), F.col(before)), 2),
    })


def daily_change(daily: DataFrame, account_id: str = "", days: int = 14) -> DataFrame:
    """Day-to-day change of one account or of all together: the latest `days` rows, a feature of the operator.

    The previous day is sought in the whole history, before the rows are cut.
    """
    # One row per calendar day by now, so a single window partition is small whatever the snapshots weigh.
    rows = changes(daily_totals(daily, account_id), "total_eval_amt", [])
    return rank.newest(rows, limits.lookback(days, 2), "snap_date").select(
        "account_id", "snap_date", "total_eval_amt", "prev_total_eval_amt", "change_amt", "change_pct",
        "account_count",
    )


def daily_change_per_account(daily: DataFrame, days: int = 14) -> DataFrame:
    """The same for every account at once, `days` rows each."""
    per_day = daily.groupBy("account_id", "snap_date").agg(F.sum("total_eval_amt").alias("total_eval_amt"))
    rows = changes(per_day, "total_eval_amt", ["account_id"])
    return rank.newest_per_key(rows, ["account_id"], limits.lookback(days, 2), "snap_date")


def daily_returns(daily: DataFrame, lookback_days: int, as_of: reads.Day | None, account_id: str = "") -> DataFrame:
    """Unrounded percent return per account and day inside the lookback; its first day has none."""
    rows = reads.lookback(_of_account(daily, account_id), as_of, limits.lookback(lookback_days, 2))
    series = rows.filter(F.col("total_eval_amt").isNotNull()).select(
        "account_id", "snap_date", "total_eval_amt",
        windows.previous("total_eval_amt", ["account_id"], "snap_date").alias("prev_total_eval_amt"),
    ).filter(F.col("prev_total_eval_amt").isNotNull())
    return series.withColumn(
        "_return", numbers.change_pct(F.col("total_eval_amt"), F.col("prev_total_eval_amt"))
    )


def anomalies(daily: DataFrame, account_id: str = "", z_threshold: float = 2.0, lookback_days: int = 90,
              limit: int | None = None, as_of: reads.Day | None = None,
              names: labels.StatusLabels = labels.StatusLabels()) -> DataFrame:
    """Daily returns scored against the account's own mean and deviation in the lookback, farthest first.

    The lookback is cut before the previous day is sought. Without an account, every account is scored on its
    own returns. `limit` keeps the farthest rows of all accounts together; without one all rows stay, unsorted.
    """
    own = Window.partitionBy("account_id")
    returns = daily_returns(daily, lookback_days, as_of, account_id)
    # The window reuses the partitioning by account that the previous-day window already made: no join.
    scored = returns.withColumn(
        "_z", numbers.z_score(F.col("_return"), F.avg("_return").over(own), F.stddev_samp("_return").over(own))
    ).withColumns({
        "return_pct": F.round("_return", 2),
        "z_score": F.round("_z", 2),
        "status": labels.anomaly_status(F.col("_z"), limits.at_least(z_threshold), names),
    })
    if limit is not None:
        scored = rank.largest_first(scored, F.abs("_z"), limits.row_limit(limit), "account_id", "snap_date")
    return scored.drop("_z", "_return")


def moving_trend(rows: DataFrame, value: str, keys: list[str], short: int, long: int,
                 names: labels.TrendLabels, day: str = "snap_date") -> DataFrame:
    """Short and long moving averages of a daily series and which is higher; full long windows only.

    The averages are compared as rounded to whole units.
    """
    wide, narrow = windows.rolling(keys, day, long), windows.rolling(keys, day, short)
    return rows.select(
        *keys, day, value,
        windows.rolling_count(value, wide).alias("_n"),
        F.round(windows.rolling_mean(value, narrow), 0).alias("short_sma"),
        F.round(windows.rolling_mean(value, wide), 0).alias("long_sma"),
    ).filter(F.col("_n") >= long).drop("_n").withColumn(
        "trend", labels.trend(F.col("short_sma"), F.col("long_sma"), names)
    )


def trend(daily: DataFrame, account_id: str = "", short_window: int = 7, long_window: int = 30,
          lookback_days: int = 90, as_of: reads.Day | None = None,
          names: labels.TrendLabels = labels.TrendLabels()) -> DataFrame:
    """Trend of one account, newest first, or of every account on its own."""
    short, long, days = limits.trend_windows(short_window, long_window, lookback_days)
    rows = reads.lookback(_of_account(daily, account_id), as_of, days).filter(F.col("total_eval_amt").isNotNull())
    return moving_trend(rows, "total_eval_amt", ["account_id"], short, long, names).orderBy(
        F.desc("snap_date"), "account_id"
    )


def valued_days(daily: DataFrame, account_id: str = "") -> DataFrame:
    """Days with a value per account: what the analytics above need enough of."""
    return _of_account(daily, account_id).filter(F.col("total_eval_amt").isNotNull()).groupBy("account_id").agg(
        F.count(F.lit(1)).alias("days")
    )


def holding_snapshots(holdings: DataFrame) -> DataFrame:
    """account_id, snap_date, holdings_at, holdings_amt and holding_count: the last snapshot of each account and day.

    `holdings` has a row per holding: account_id, snapshot_at and value_krw. Rows of one account and time are one
    snapshot. Sums and choice combine within tasks, however many lines a snapshot has.
    """
    whole = holdings.filter(F.col("account_id").isNotNull() & F.col("snapshot_at").isNotNull()).groupBy(
        "account_id", "snapshot_at").agg(
        F.coalesce(F.sum("value_krw"), F.lit(0)).alias("holdings_amt"), F.count(F.lit(1)).alias("holding_count"))
    day = F.col("snapshot_at").cast("date").alias("snap_date")
    last = F.max_by(F.struct(F.col("snapshot_at").alias("holdings_at"), "holdings_amt", "holding_count"), "snapshot_at")
    return whole.groupBy("account_id", day).agg(last.alias("_last")).select("account_id", "snap_date", "_last.*")


def account_nav(daily: DataFrame, holdings: DataFrame) -> DataFrame:
    """Value, holdings and residual cash per account and valued day.

    The holdings of a day are those of the account's latest snapshot on that day or before (`holdings_at`), NULL
    before the first; their cash is the value less the holdings, not below 0. The as-of join is a union of both
    tables' days and a value carried forward, so no account is joined with itself.
    """
    held = ["holdings_at", "holdings_amt", "holding_count"]
    snapshots = holding_snapshots(holdings)
    none = [F.lit(None).cast(snapshots.schema[name].dataType).alias(name) for name in held]
    both = daily.select("account_id", "snap_date", F.col("total_eval_amt").cast("bigint").alias("total_eval_amt"),
                        *none).unionByName(snapshots.withColumn("total_eval_amt", F.lit(None).cast("bigint")))
    # One row per account and day: at most one snapshot, and the values of the account's types added up.
    days = both.groupBy("account_id", "snap_date").agg(
        F.sum("total_eval_amt").alias("total_eval_amt"), *[F.max(name).alias(name) for name in held])
    carried = carry_forward(days, ["account_id"], "snap_date", held).filter(F.col("total_eval_amt").isNotNull())
    return carried.withColumn("cash_amt", residual(F.col("total_eval_amt"), F.col("holdings_amt")))


def residual(total: Column, used: Column) -> Column:
    return F.greatest(F.coalesce(total, F.lit(0)) - F.coalesce(used, F.lit(0)), F.lit(0))
