"""Realised profits by symbol and day, from raw reports of overlapping date ranges.

Of the reports that cover a day of an account and market the latest fetched one speaks for it, whether it lists a trade or
no longer does. Ranges meet days by equality: a range is cut into the whole months and the single days that it is made
of, so ten years are 120 months and 60 days at most, and the latest report of each month and each day is found by an
aggregate that combines within tasks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import numbers, payload, text

# Column -> candidate member names of domestic and overseas reports, first filled one wins.
DATE, SYMBOL = ("trad_dt", "trad_day"), ("pdno", "ovrs_pdno")
NAMES = ("prdt_name", "ovrs_item_name")
AMOUNTS = {
    "buy_qty": ("buy_qty",),
    "buy_amt": ("buy_amt", "stck_buy_amt_smtl"),
    "sell_qty": ("sll_qty", "slcl_qty"),
    "sell_amt": ("sll_amt", "stck_sll_amt_smtl"),
    "profit_amt": ("rlzt_pfls", "ovrs_rlzt_pfls_amt"),
    "fee_amt": ("fee", "stck_sll_tlex"),
    "tax_amt": ("tl_tax",),
}

_REPORT = ["account_id", "market_type"]
_MEMBERS = payload.Members(*DATE, *SYMBOL, *NAMES, *[name for names in AMOUNTS.values() for name in names])


class Profits(NamedTuple):
    rows: DataFrame
    rejects: DataFrame


def _first(*names: str) -> Column:
    return F.coalesce(*[_MEMBERS.get(name) for name in names])


def report_rows(reports: DataFrame) -> Profits:
    """The listed trades of each report, and those that cannot count: without a symbol or a day, or outside the
    report's own range.

    `reports` holds id, account_id, market_type, start_date, end_date, fetched_at and data, as the table of raw reports
    does. A report that is not a JSON object, or lists nothing, has no rows; it still speaks for its days.
    """
    listed = _MEMBERS.explode(reports, payload.items(F.col("data"), "output1")).select(
        *_REPORT, "id", "fetched_at", "start_date", "end_date",
        text.parse_day_or_iso(_first(*DATE)).alias("trade_date"),
        text.blank_to_null(F.trim(_first(*SYMBOL))).alias("symbol"), _first(*NAMES).alias("symbol_name"),
        *[numbers.parse_number(_first(*names)).alias(column) for column, names in AMOUNTS.items()],
        F.col("_place").alias("place"),
    )
    usable = F.coalesce(F.col("symbol").isNotNull() & F.col("trade_date").between(F.col("start_date"), F.col("end_date")),
                        F.lit(False))
    return Profits(listed.filter(usable), listed.filter(~usable))


def covers(reports: DataFrame) -> DataFrame:
    """The months and days that make up each report's range: `whole` (a whole month) and `from` (its first day). A
    range that ends before it starts, or lacks an end, has none."""
    start, end = F.col("start_date"), F.col("end_date")
    month_of_start, month_of_end = F.trunc(start, "month"), F.trunc(end, "month")
    first = F.when(start == month_of_start, start).otherwise(F.add_months(month_of_start, 1))
    last = F.when(end == F.last_day(end), month_of_end).otherwise(F.add_months(month_of_end, -1))
    bounds = reports.filter(start <= end).withColumns({"_first": first.cast("date"), "_last": last.cast("date")})
    some = F.col("_first") <= F.col("_last")
    none = F.array().cast("array<date>")
    months = F.when(some, F.sequence("_first", "_last", F.expr("INTERVAL 1 MONTH"))).otherwise(none)
    head_end = F.when(some, F.date_sub("_first", 1)).otherwise(end)
    tail = F.add_months("_last", 1)
    days = F.concat(
        F.when(start <= head_end, F.sequence(start, head_end)).otherwise(none),
        F.when(some & (tail <= end), F.sequence(tail, end)).otherwise(none))
    pieces = F.concat(
        F.transform(months, lambda d: F.struct(F.lit(True).alias("whole"), d.alias("from"))),
        F.transform(days, lambda d: F.struct(F.lit(False).alias("whole"), d.alias("from"))))
    return bounds.select(*_REPORT, "id", "fetched_at", F.explode(pieces).alias("_piece")).select(
        *_REPORT, "id", "fetched_at", "_piece.whole", "_piece.from")


def speaking_reports(reports: DataFrame, days: DataFrame) -> DataFrame:
    """account_id, market_type, trade_date and `id` of the latest fetched report that covers each of `days`; of equal
    times the one with the higher id."""
    latest = covers(reports).groupBy(*_REPORT, "whole", "from").agg(F.max(F.struct("fetched_at", "id")).alias("_told"))
    of_day = latest.filter("not whole").select(*_REPORT, F.col("from").alias("trade_date"), F.col("_told").alias("_day"))
    of_month = latest.filter("whole").select(*_REPORT, F.col("from").alias("_month"), F.col("_told").alias("_whole"))
    asked = days.select(*_REPORT, "trade_date").distinct().withColumn("_month", F.trunc("trade_date", "month"))
    found = asked.join(of_day, [*_REPORT, "trade_date"], "left").join(of_month, [*_REPORT, "_month"], "left")
    return found.select(*_REPORT, "trade_date", F.greatest("_day", "_whole")["id"].alias("id")).filter(
        F.col("id").isNotNull())


def trade_profits(reports: DataFrame) -> DataFrame:
    """One row per account, market, day and symbol: what the report that speaks for the day lists of it.

    Several rows of one symbol and day in that report are lots, and are added up; `report_id` and `fetched_at` say where
    the row is from.
    """
    rows = report_rows(reports).rows
    told = speaking_reports(reports, rows)
    kept = rows.join(told, [*_REPORT, "trade_date", "id"])
    return kept.groupBy(*_REPORT, "trade_date", "symbol", F.col("id").alias("report_id"), "fetched_at").agg(
        F.min_by("symbol_name", "place").alias("symbol_name"),
        *[F.sum(column).alias(column) for column in AMOUNTS], F.count(F.lit(1)).alias("lots"))
