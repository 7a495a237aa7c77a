"""Checks of query parameters, made on the driver before a plan is built. Nothing is cut: a bad value raises."""

from __future__ import annotations


def _whole(value: float, low: int, what: str) -> int:
    if int(value) != value or value < low:
        raise ValueError(f"{what} must be a whole number of at least {low}, not {value}")
    return int(value)


def lookback(days: int, low: int = 1) -> int:
    """A number of days or rows, of any size from `low` on."""
    return _whole(days, low, "a lookback")


def band_window(window: int) -> int:
    return _whole(window, 2, "a band window")


def row_limit(limit: int | None) -> int | None:
    """A number of rows, or None for all of them."""
    return None if limit is None else _whole(limit, 1, "a limit")


def at_least(value: float, low: float = 0.1) -> float:
    if not value >= low:
        raise ValueError(f"must be at least {low}, not {value}")
    return float(value)


def trend_windows(short: int, long: int, days: int) -> tuple[int, int, int]:
    """Short window, long window not below it, and a lookback not below that, as asked for."""
    short = _whole(short, 2, "a short window")
    long = _whole(long, short, "a long window")
    return short, long, _whole(days, long, "a trend's lookback")


def top_n(n: int) -> int:
    return _whole(n, 1, "a top list")
