"""Accounts and the trading calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.functions.text import SEOUL, mask

# Account labels with their display names, and account types by product code.
ACCOUNT_NAMES = {
    "ria": "위험자산 일임",
    "isa": "ISA",
    "brokerage": "일반 위탁",
    "irp": "IRP 퇴직연금",
    "pension": "연금저축",
}
PRODUCT_TYPES = {"01": "brokerage", "22": "pension", "29": "irp"}
PENSION_PRODUCT = "29"

# The exchange's hours, notes and source name.
MARKET = "krx"
OPEN_TIME, CLOSE_TIME = "09:00", "15:30"
CALENDAR_SOURCE = "generated:holidays.KR+krx_rules"
WEEKEND_NOTE, HOLIDAY_NOTE = "주말 휴장", "공휴일 휴장: "
LABOR_DAY_NOTE, YEAR_END_NOTE = "근로자의 날 휴장", "연말 휴장"


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(item) for pair in values.items() for item in pair]), key)


def account_type(label: Column, product_code: Column) -> Column:
    """The configured label if it is a known one, else the type of the product code, else `unknown`."""
    known = F.when(label.isin(*ACCOUNT_NAMES), label)
    return F.coalesce(known, _lookup(PRODUCT_TYPES, product_code), F.lit("unknown"))


def uses_pension_api(product_code: Column) -> Column:
    return product_code == PENSION_PRODUCT


def account_dimension(accounts: DataFrame) -> DataFrame:
    """`(account_id, label, product_code)` to label, display name, type and masked number."""
    return accounts.withColumns({
        "account_type": account_type(F.col("label"), F.col("product_code")),
        "display_name": F.coalesce(_lookup(ACCOUNT_NAMES, F.col("label")), F.col("label")),
        "masked_number": mask(F.col("account_id")),
    })


def with_account_type(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """`rows` with their account type: the configured account's label, else the product code's type.

    Spark measures `accounts` and broadcasts it only under its size threshold.
    """
    labels = accounts.select("account_id", F.col("label").alias("_label"))
    product = F.col("account_product_code") if "account_product_code" in rows.columns else F.col("product_code")
    return rows.join(labels, "account_id", "left").withColumn(
        "account_type", account_type(F.col("_label"), product)
    ).drop("_label")


def is_weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def _calendar_days(years: DataFrame, holidays: DataFrame) -> DataFrame:
    """Every date of each year with its holiday name; keys of `years` other than `year` are kept."""
    first = F.make_date(F.col("year"), F.lit(1), F.lit(1))
    last = F.make_date(F.col("year"), F.lit(12), F.lit(31))
    days = years.withColumn("trade_date", F.explode(F.sequence(first, last)))
    names = holidays.groupBy(F.col("date").alias("trade_date")).agg(F.min("name").alias("holiday_name"))
    return days.join(names, "trade_date", "left")


def year_end_closures(years: DataFrame, holidays: DataFrame) -> DataFrame:
    """Per year the last date that is neither a weekend nor a holiday."""
    keys = years.columns
    business = ~is_weekend(F.col("trade_date")) & F.col("holiday_name").isNull()
    return _calendar_days(years, holidays).filter(business).groupBy(*keys).agg(
        F.max("trade_date").alias("closure_date")
    )


def trading_calendar(years: DataFrame, holidays: DataFrame, market: str = MARKET) -> DataFrame:
    """One row per date of each year, open or closed and why.

    A weekend outranks a holiday, a holiday May 1, and that the year-end closure. `years` may carry a
    `market` column; else every row gets `market`.
    """
    if "market" not in years.columns:
        years = years.withColumn("market", F.lit(market))
    day = F.col("trade_date")
    weekend, holiday = is_weekend(day), F.col("holiday_name")
    # One market's year per partition, 366 rows at most.
    year_of_market = Window.partitionBy(*years.columns)
    days = _calendar_days(years, holidays).withColumn(
        "closure_date", F.max(F.when(~weekend & holiday.isNull(), day)).over(year_of_market)
    )
    labor = (F.month(day) == 5) & (F.dayofmonth(day) == 1)
    year_end = F.coalesce(day == F.col("closure_date"), F.lit(False))
    note = (
        F.when(weekend, WEEKEND_NOTE)
        .when(holiday.isNotNull(), F.concat(F.lit(HOLIDAY_NOTE), holiday))
        .when(labor, LABOR_DAY_NOTE)
        .when(year_end, YEAR_END_NOTE)
    )
    is_open = F.col("note").isNull()
    facts = F.struct(
        holiday.alias("public_holiday_name"), weekend.alias("is_weekend"), labor.alias("is_labor_day"),
        year_end.alias("is_year_end_closure"),
    )
    return days.withColumn("note", note).select(
        "market", "trade_date",
        is_open.alias("is_open"),
        F.when(is_open, OPEN_TIME).alias("open_time_local"),
        F.when(is_open, CLOSE_TIME).alias("close_time_local"),
        F.lit(SEOUL).alias("timezone"),
        F.lit(CALENDAR_SOURCE).alias("source"),
        "note",
        F.to_json(facts, {"ignoreNullFields": "false"}).alias("raw_data"),
    )
