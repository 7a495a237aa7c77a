"""Filters and range reads. Each is a plain filter and sort, so Spark pushes it into the scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import limits
from folioframe.operators import rank

Day = dt.date | str
MONTH = "month"


def as_day(value: Day) -> dt.date:
    """A date from a date, `YYYYMMDD` or `YYYY-MM-DD`."""
    if isinstance(value, dt.date):
        return value
    return dt.datetime.strptime(value.replace("-", ""), "%Y%m%d").date()


def between_days(column: str, start: Day, end: Day) -> Column:
    """Both ends included."""
    return F.col(column).between(F.lit(as_day(start)), F.lit(as_day(end)))


def prices(history: DataFrame, symbol: str, exchange: str, start: Day, end: Day) -> DataFrame:
    return history.filter(
        (F.col("symbol") == symbol) & (F.col("exchange") == exchange) & between_days("date", start, end)
    ).orderBy("date")


def has_prices(history: DataFrame, requests: DataFrame) -> DataFrame:
    """Each `(symbol, exchange, start_date, end_date)` request with `covered`: whether any price is in range.

    The history is reduced to the set of days of each symbol, of a size bounded by the calendar, so that no
    pairs of requests and days are made.
    """
    keys = ["symbol", "exchange"]
    days = history.groupBy(*keys).agg(F.collect_set("date").alias("_days"))
    within = F.exists("_days", lambda day: day.between(F.col("start_date"), F.col("end_date")))
    return requests.join(days, keys, "left").withColumn("covered", F.coalesce(within, F.lit(False))).drop("_days")


def rates(history: DataFrame, currency: str, start: Day | None = None, end: Day | None = None,
          period: str = "D") -> DataFrame:
    """Rates of one currency; the range defaults to 2000-01-01 until today."""
    last = F.lit(as_day(end)) if end else F.current_date()
    return history.filter(
        (F.col("currency") == currency.upper()) & (F.col("period") == period)
        & F.col("date").between(F.lit(as_day(start or "20000101")), last)
    ).orderBy("date")


def _snapshot_range(rows: DataFrame, start: Day | None, end: Day | None, limit: int | None,
                    tie: str) -> DataFrame:
    """Newest first, all or the first `limit`. The end day counts up to its last instant."""
    if start:
        rows = rows.filter(F.col("snapshot_at") >= F.lit(as_day(start)).cast("timestamp_ntz"))
    if end:
        after = as_day(end) + dt.timedelta(days=1)
        rows = rows.filter(F.col("snapshot_at") < F.lit(after).cast("timestamp_ntz"))
    return rank.newest(rows, limits.row_limit(limit), "snapshot_at", F.desc(tie))


def portfolio_snapshots(snapshots: DataFrame, account_id: str, start: Day | None = None,
                        end: Day | None = None, limit: int | None = None) -> DataFrame:
    return _snapshot_range(snapshots.filter(F.col("account_id") == account_id), start, end, limit, "id")


def overview_snapshots(snapshots: DataFrame, start: Day | None = None, end: Day | None = None,
                       limit: int | None = None) -> DataFrame:
    return _snapshot_range(snapshots, start, end, limit, "id")


def newest_first(orders: DataFrame) -> DataFrame:
    return orders.orderBy(F.desc("order_date"), F.desc_nulls_last("order_time"), F.desc("order_no"))


def orders(canonical: DataFrame, account_id: str, product_code: str, start: Day, end: Day,
           symbol: str = "") -> DataFrame:
    """Orders of one account and date range, newest first; the symbol is compared without regard to case."""
    rows = canonical.filter(
        (F.col("account_id") == account_id) & (F.col("account_product_code") == product_code)
        & between_days("order_date", start, end)
    )
    if symbol:
        rows = rows.filter(F.upper("symbol") == symbol.upper())
    return newest_first(rows)


def latest_observations(observations: DataFrame, requests: DataFrame, payload: bool = True) -> DataFrame:
    """For each request, the raw observation that serves it, with its `data` unless `payload` is false.

    `requests` holds account_id, account_product_code, market_type, start_date and end_date; `observations`
    is the raw order history. Dates must match exactly. An observation of the same product is preferred to
    one without a product; then the latest, then the highest id. Requests without one are left out.
    """
    span = ["account_id", "market_type", "start_date", "end_date"]
    asked = requests.select(*span, "account_product_code").distinct()
    # Only what is asked for is looked at, and the winners are found without their payloads.
    wanted = observations.join(asked.select(*span).distinct(), span, "left_semi")
    newest = wanted.groupBy(*span, "account_product_code").agg(
        F.max(F.struct("fetched_at", "id", "account_type")).alias("_obs")
    )
    product = F.col("newest.account_product_code")
    # At most two candidates a request are left: its own product's and the one without.
    found = asked.alias("asked").join(newest.alias("newest"), span).filter(
        product.isNull() | (product == F.col("asked.account_product_code"))
    ).select(*span, F.col("asked.account_product_code"), product.isNotNull().alias("_exact"), "_obs")
    best = F.max(F.struct("_exact", "_obs")).alias("_best")
    winners = found.groupBy(*span, "account_product_code").agg(best).select(
        *span, "account_product_code", "_best._obs.id", "_best._obs.account_type", "_best._obs.fetched_at"
    )
    return with_payloads(winners, observations) if payload else winners


def with_payloads(winners: DataFrame, observations: DataFrame) -> DataFrame:
    """Rows of `latest_observations` found without payloads, with the `data` of their observations."""
    span = ["account_id", "market_type", "start_date", "end_date"]
    # The span and, of a stored table, the month lead to the winners' files.
    month = [MONTH] if MONTH in observations.columns else []
    found = winners.withColumn(MONTH, F.date_format("fetched_at", "yyyy-MM")) if month else winners
    return found.join(observations.select(*span, *month, "id", "data"), [*span, *month, "id"]).drop(*month)


def calendar_entry(calendar: DataFrame, market: str, day: Day) -> DataFrame:
    return calendar.filter((F.col("market") == market) & (F.col("trade_date") == F.lit(as_day(day))))


def calendar_completeness(calendar: DataFrame) -> DataFrame:
    """Stored days against days in the year, per market and year."""
    year = F.year("trade_date").alias("year")
    counts = calendar.groupBy("market", year).agg(F.count(F.lit(1)).alias("stored_days"))
    january = F.make_date(F.col("year"), F.lit(1), F.lit(1))
    days = F.datediff(F.add_months(january, 12), january).cast("bigint")
    return counts.withColumn("expected_days", days).withColumn(
        "complete", F.col("stored_days") >= F.col("expected_days")
    )


def instrument(table: DataFrame, symbol: str, market: str = "KRX") -> DataFrame:
    """One row of the master or of the overrides."""
    return table.filter((F.col("symbol") == symbol) & (F.col("market") == market))


def instruments(table: DataFrame, symbols: DataFrame, market: str = "KRX") -> DataFrame:
    """Rows of the master or of the overrides for a `symbol` column of any length."""
    wanted = symbols.select("symbol").distinct()
    return table.filter(F.col("market") == market).join(wanted, "symbol", "left_semi")


def since(as_of: Day | Column | None, days: int) -> Column:
    """First day of a lookback of `days` from `as_of`, today by default."""
    if as_of is None:
        end = F.current_date()
    else:
        end = as_of if isinstance(as_of, Column) else F.lit(as_day(as_of))
    return F.date_sub(end, days)


def lookback(daily: DataFrame, as_of: Day | Column | None, days: int) -> DataFrame:
    """Rows of the last `days` days. Rows of a table split by month are also filtered by month, which spares the
    files of earlier ones."""
    first = since(as_of, limits.lookback(days))
    rows = daily.filter(F.col("snap_date") >= first)
    return rows.filter(F.col(MONTH) >= F.date_format(first, "yyyy-MM")).drop(MONTH) if MONTH in daily.columns else rows
