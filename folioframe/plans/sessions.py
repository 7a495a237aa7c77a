"""Market sessions in universal time, and which session an event falls into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BOUNDS = ("open_at", "close_at")


def market_sessions(calendar: DataFrame) -> DataFrame:
    """market, trade_date, open_at and close_at (UTC, without zone) and `minutes` of every open day.

    `calendar` holds local hours and the zone they are in, so a session moves with the zone's clock changes, and a half
    day is one with its own closing time. A session that closes before it opens closes on the next day. Days without
    hours or a zone have no session.
    """
    def instant(time: str) -> Column:
        local = F.to_timestamp_ntz(F.concat_ws(" ", F.date_format("trade_date", "yyyy-MM-dd"), F.col(time)), F.lit("yyyy-MM-dd HH:mm"))
        return F.convert_timezone(F.col("timezone"), F.lit("UTC"), local)

    hours = calendar.filter(F.col("is_open") & F.col("timezone").isNotNull()).filter(
        F.col("open_time_local").isNotNull() & F.col("close_time_local").isNotNull())
    late = F.col("close_time_local") <= F.col("open_time_local")
    next_close = F.convert_timezone(F.col("timezone"), F.lit("UTC"), F.to_timestamp_ntz(F.concat_ws(
        " ", F.date_format(F.date_add("trade_date", 1), "yyyy-MM-dd"), F.col("close_time_local")), F.lit("yyyy-MM-dd HH:mm")))
    return hours.select(
        "market", "trade_date", instant("open_time_local").alias("open_at"),
        F.when(late, next_close).otherwise(instant("close_time_local")).alias("close_at"),
    ).withColumn("minutes", _minutes(F.col("open_at"), F.col("close_at")))


def _minutes(first: Column, last: Column) -> Column:
    return (last - first).cast("interval minute").cast("bigint")


def tag_sessions(events: DataFrame, sessions: DataFrame, time: str = "at") -> DataFrame:
    """`events` (market and a UTC time without zone) with session_date, minutes_from_open and minutes_to_close; NULL
    outside of all sessions. A session holds its opening instant, not its closing one.

    Sessions of a market do not overlap. Each is listed under the one or two UTC days that it touches, so an event
    meets the handful of sessions of its market and day by equality, and only there bounds are compared. Events of one
    market may be a third of all: the sessions are unique per market and day, and Spark may split the join.
    """
    days = F.sequence(F.col("open_at").cast("date"), F.col("close_at").cast("date"))
    listed = sessions.select("market", "trade_date", *_BOUNDS, F.explode(days).alias("_day")).groupBy("market", "_day").agg(
        F.collect_list(F.struct(*_BOUNDS, "trade_date")).alias("_sessions"))
    met = events.withColumn("_day", F.col(time).cast("date")).join(listed, ["market", "_day"], "left")
    at = F.col(time)
    session = F.get(F.filter("_sessions", lambda s: (s["open_at"] <= at) & (at < s["close_at"])), F.lit(0))
    return met.withColumn("_session", session).select(
        *[F.col(f"`{name}`") for name in events.columns],
        F.col("_session.trade_date").alias("session_date"),
        _minutes(F.col("_session.open_at"), at).alias("minutes_from_open"),
        _minutes(at, F.col("_session.close_at")).alias("minutes_to_close"))
