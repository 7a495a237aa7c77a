"""Exchange rates by day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.operators.carry import carry_forward, day_spine


def fx_daily(rates: DataFrame, period: str = "D", until: dt.date | str | Column | None = None,
             order: list[str] | None = None) -> DataFrame:
    """A rate for every currency and day from the currency's first rate on: the last known one.

    `rates` has currency, date, period and rate; several rows of a currency and day count by their `order` columns, the
    last one wins (without `order` the highest rate). Rows without a currency, a date or a rate, or with a rate of 0,
    tell nothing. The days end at `until`, or at the last day any currency has. `rate_date` is the day the rate was
    observed and `stale_days` how long ago that was.
    """
    known = rates.filter((F.col("period") == period) & F.col("currency").isNotNull() & F.col("date").isNotNull()
                         & F.col("rate").isNotNull() & (F.col("rate") != 0)).withColumn("currency", F.upper("currency"))
    pick = F.max_by("rate", F.struct(*order)) if order else F.max("rate")
    observed = known.groupBy("currency", "date").agg(pick.alias("rate"))
    spine = day_spine(known.select("currency", "date"), ["currency"], "date", until)
    days = spine.join(observed, ["currency", "date"], "left").withColumn(
        "rate_date", F.when(F.col("rate").isNotNull(), F.col("date")))
    carried = carry_forward(days, ["currency"], "date", ["rate", "rate_date"])
    return carried.select("currency", "date", "rate", "rate_date", F.datediff("date", "rate_date").alias("stale_days"))
