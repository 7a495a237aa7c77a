"""Last value of each day from append-only snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERVIEW_COLUMNS = (
    "id", "base_currency", "domestic_eval_amt_krw", "overseas_stock_eval_amt_krw", "overseas_cash_amt_krw",
    "overseas_total_asset_amt_krw", "total_eval_amt_krw", "domestic_pct", "overseas_pct", "overseas_stock_pct",
    "overseas_cash_pct", "domestic_direct_amt_krw", "overseas_direct_amt_krw", "overseas_indirect_amt_krw",
    "cash_amt_krw", "unknown_amt_krw", "allocation_data", "classification_summary", "overview_data",
)


def time_rank(time: str, tie_breaker: str | None) -> Column:
    """Ordering of snapshots. The tie-breaker makes reruns agree on snapshots of the same instant; without one
    the aggregate keeps fixed-width state and Spark can hash it instead of sorting."""
    return F.struct(time, tie_breaker) if tie_breaker else F.col(time)


def last_values(df: DataFrame, keys: list, columns: list[str], time: str = "snapshot_at",
                tie_breaker: str | None = "id", never_null: tuple[str, ...] = ()) -> DataFrame:
    """Per key the latest non-NULL value of each column, and the latest time.

    Each column looks back on its own, so one output row may combine several snapshots. A `max_by` combines on
    the map side: a key holding a third of the rows sends one row per input task.
    """
    rank = time_rank(time, tie_breaker)

    def last(name: str) -> Column:
        order = rank if name in never_null else F.when(F.col(name).isNotNull(), rank)
        return F.max_by(name, order).alias(name)

    return df.groupBy(*keys).agg(F.max(time).alias(time), *[last(name) for name in columns])


def day_of(df: DataFrame, time: str = "snapshot_at") -> Column:
    """The stored day column where the table has one, so that file pruning sees filters on it."""
    return F.col("snap_date") if "snap_date" in df.columns else F.col(time).cast("date").alias("snap_date")


def _month(df: DataFrame) -> list[str]:
    """The month that a stored table is split by, kept with the day it follows from so that lookbacks prune files."""
    return [name for name in ("month",) if name in df.columns]


def portfolio_daily(snapshots: DataFrame, tie_breaker: str | None = "id") -> DataFrame:
    """Last valued snapshot of each account and day."""
    columns = [name for name in ("total_eval_amt", "balance_data") if name in snapshots.columns]
    return last_values(
        snapshots.filter(F.col("total_eval_amt").isNotNull()),
        ["account_id", "account_type", day_of(snapshots), *_month(snapshots)],
        columns, tie_breaker=tie_breaker, never_null=("total_eval_amt",),
    )


def overview_daily(snapshots: DataFrame, tie_breaker: str | None = "id") -> DataFrame:
    """Last total-asset overview of each day, column by column."""
    columns = [name for name in OVERVIEW_COLUMNS if name in snapshots.columns]
    return last_values(
        snapshots.filter(F.col("total_eval_amt_krw").isNotNull()), [day_of(snapshots), *_month(snapshots)], columns,
        tie_breaker=tie_breaker, never_null=("total_eval_amt_krw",),
    )


def latest_snapshots(snapshots: DataFrame, require_total: bool = True, since: Column | None = None,
                     tie_breaker: str = "id") -> DataFrame:
    """The latest snapshot row of each account, whole.

    `require_total=False` also takes snapshots without a value; holdings read that way may then disagree with
    totals read the other way.
    """
    if require_total:
        snapshots = snapshots.filter(F.col("total_eval_amt").isNotNull())
    if since is not None:
        snapshots = snapshots.filter(F.col("snapshot_at") >= since.cast("timestamp_ntz"))
    rest = [name for name in snapshots.columns if name != "account_id"]
    newest = F.max_by(F.struct(*rest), time_rank("snapshot_at", tie_breaker)).alias("_last")
    return snapshots.groupBy("account_id").agg(newest).select("account_id", "_last.*")


def last_per_minute(snapshots: DataFrame, tie_breaker: str | None = "id") -> DataFrame:
    """As `portfolio_daily` at minute grain."""
    minute = F.date_trunc("minute", "snapshot_at").cast("timestamp_ntz").alias("snap_minute")
    return last_values(
        snapshots.filter(F.col("total_eval_amt").isNotNull()), ["account_id", "account_type", minute],
        ["total_eval_amt"], tie_breaker=tie_breaker, never_null=("total_eval_amt",),
    )
