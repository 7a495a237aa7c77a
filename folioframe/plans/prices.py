"""Bollinger bands over stored prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions import labels, limits, numbers
from folioframe.operators import rank, windows

_KEYS = ["symbol", "exchange"]


def bollinger_bands(history: DataFrame, symbol: str = "", exchange: str = "KRX", window: int = 20,
                    num_std: float = 2.0, limit: int | None = None,
                    names: labels.BandLabels = labels.BandLabels()) -> DataFrame:
    """Moving mean of closes with bands `num_std` deviations around it, newest first.

    Rows need a full window. Without a symbol all symbols of all exchanges are done in one pass. `limit` keeps
    the newest rows of each symbol; without one all rows stay. The signal compares unrounded values.
    """
    window, limit = limits.band_window(window), limits.row_limit(limit)
    reach = F.lit(limits.at_least(num_std))
    rows = history.filter(F.col("close").isNotNull())
    if symbol:
        rows = rows.filter((F.col("symbol") == symbol) & (F.col("exchange") == exchange))
    frame = windows.rolling(_KEYS, "date", window)
    stats = rows.select(
        *_KEYS, "date", "close",
        windows.rolling_count("close", frame).alias("_n"),
        windows.rolling_mean("close", frame).alias("_mean"),
        windows.rolling_std("close", frame).alias("_std"),
    ).filter(F.col("_n") >= window)
    mean, std, close = F.col("_mean"), F.col("_std"), F.col("close")
    upper, lower = mean + reach * std, mean - reach * std
    full = stats if symbol else rank.newest_per_key(stats, _KEYS, limit, "date")
    bands = full.select(
        *_KEYS, "date", "close",
        F.round(mean, 2).alias("sma"),
        F.round(upper, 2).alias("upper_band"),
        F.round(lower, 2).alias("lower_band"),
        F.round(numbers.z_score(close, mean, std), 2).alias("z_score"),
        labels.band_signal(close, upper, lower, names).alias("signal"),
    )
    return rank.newest(bands, limit, "date") if symbol else bands


def price_counts(history: DataFrame) -> DataFrame:
    """Usable closes per symbol: what a band needs at least a window of."""
    return history.filter(F.col("close").isNotNull()).groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("rows"))
