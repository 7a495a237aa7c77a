"""Numbers from payload text, and the ratios built on them. Bad input gives NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(text: Column) -> Column:
    """Double from plain number text. Java's type suffixes (`1d`, `5f`) are no part of a number."""
    number = text.try_cast("double")
    return F.when(~F.coalesce(text.rlike("[0-9.][dDfF]\\s*$"), F.lit(False)), number)


def parse_number(text: Column) -> Column:
    """Double from text that may carry thousands commas, a dollar or a percent sign.

    The two usual marks for a missing number are told apart first: a failed cast costs far more than a test.
    """
    return F.when(~text.isin("", "-"), _double(F.translate(text, ",$%", "")))


def parse_int(text: Column) -> Column:
    """`parse_number` cut toward zero."""
    return parse_number(text).try_cast("bigint")


def truncate(number: Column) -> Column:
    """Whole part of a double, toward zero."""
    return number.try_cast("bigint")


def strict_int(text: Column) -> Column:
    """Whole-number text only: `12.5` is NULL."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("bigint")


def strict_float(text: Column) -> Column:
    return _double(F.replace(text, F.lit(","), F.lit("")))


def lenient_int(text: Column) -> Column:
    """Whole part of number text with commas: `1,234.0` is 1234."""
    return _double(F.replace(text, F.lit(","), F.lit(""))).try_cast("bigint")


def first_number(*texts: Column) -> Column:
    """First of the texts that parses."""
    return F.coalesce(*[parse_number(text) for text in texts])


def ratio_pct(part: Column, whole: Column) -> Column:
    """`part / whole * 100`, NULL when `whole` is 0 or NULL."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) * F.lit(100.0)


def pct(part: Column, whole: Column) -> Column:
    return F.round(ratio_pct(part, whole), 2)


def change_pct(value: Column, previous: Column) -> Column:
    """Percent change from `previous`, unrounded."""
    return (value - previous) / F.nullif(previous.cast("double"), F.lit(0.0)) * F.lit(100.0)


def z_score(value: Column, mean: Column, std: Column) -> Column:
    """Unrounded; NULL when the spread is 0 or unknown."""
    return (value - mean) / F.nullif(std, F.lit(0.0))
