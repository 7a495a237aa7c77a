"""Whether a market day's data may be collected yet, and the calendar that says so, kept whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions.text import seoul_time
from folioframe.operators import merge, tables
from folioframe.operators.reads import calendar_completeness
from folioframe.sources.dimensions import CLOSE_TIME, MARKET, trading_calendar

CALENDAR = "market_calendar"


def asked_years(requests: DataFrame, markets: tuple[str, ...] = (MARKET,)) -> DataFrame:
    """The distinct (market, year) that `requests` (market, trade_date) ask for, of markets whose days can be made."""
    wanted = requests.filter(F.col("market").isin(*markets) & F.col("trade_date").isNotNull())
    return wanted.select("market", F.year("trade_date").alias("year")).distinct()


def incomplete_years(calendar: DataFrame, wanted: DataFrame) -> DataFrame:
    """The (market, year) of `wanted` that the calendar lacks, in whole or in part."""
    whole = calendar_completeness(calendar).filter("complete").select("market", "year")
    return wanted.select("market", "year").distinct().join(whole, ["market", "year"], "left_anti")


def complete_calendar(spark: SparkSession, root: str, wanted: DataFrame, holidays: DataFrame,
                      now: Column) -> tables.Written:
    """Make every (market, year) of `wanted` whole in the stored calendar; returns the rows written.

    Only years with a gap are generated and merged by market and day, and only their parts of the table are rewritten;
    days of a year that was whole stay as they are, whoever wrote them. A second run finds no gap and writes nothing.
    """
    stored = tables.read_table(spark, root, CALENDAR)
    gaps = incomplete_years(stored, wanted)
    # A handful of years: as rows, so that the merge does not read the table again to find them.
    found = [(row["market"], row["year"]) for row in gaps.collect()]
    if not found:
        return tables.Written(0, 0)
    years = spark.createDataFrame(found, "market string, year int")
    days = trading_calendar(years, holidays).withColumn("generated", F.lit(0))
    return tables.rewrite(spark, root, CALENDAR, days,
                          lambda target, new: merge.upsert_calendar(target, new, now, ["generated"]))


def gate_stored(spark: SparkSession, root: str, requests: DataFrame, holidays: DataFrame, now: Column,
                close_grace_minutes: int = 5) -> DataFrame:
    """`collection_gate` against the stored calendar, after the years that `requests` ask for are made whole."""
    complete_calendar(spark, root, asked_years(requests), holidays, now)
    return collection_gate(requests, tables.read_table(spark, root, CALENDAR), close_grace_minutes)


def collection_gate(requests: DataFrame, calendar: DataFrame, close_grace_minutes: int = 5) -> DataFrame:
    """`requests` with local time, calendar facts, `status` (collect or skipped) and `reason`.

    `requests` has market, trade_date and now (UTC, without zone). A day in the calendar's past or future is
    not held back by the clock, only the local day itself until the close and its grace.
    """
    facts = calendar.select("market", "trade_date", "is_open", "open_time_local", "close_time_local", "note")
    local = F.col("now_local")
    close = F.coalesce("close_time_local", F.lit(CLOSE_TIME))
    cutoff = F.to_timestamp_ntz(
        F.concat_ws(" ", F.date_format("trade_date", "yyyy-MM-dd"), close), F.lit("yyyy-MM-dd HH:mm")
    ) + F.make_dt_interval(mins=F.lit(close_grace_minutes))
    reason = (
        F.when(F.col("is_open").isNull(), "calendar_missing")
        .when(~F.col("is_open"), "market_closed")
        .when((local.cast("date") == F.col("trade_date")) & (local < cutoff), "before_close_grace_window")
        .otherwise("ready")
    )
    return (
        requests.withColumn("now_local", seoul_time(F.col("now")))
        .join(facts, ["market", "trade_date"], "left")
        .withColumn("reason", reason)
        .withColumn("status", F.when(F.col("reason") == "ready", "collect").otherwise("skipped"))
    )
