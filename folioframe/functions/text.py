"""Dates, flags, identifiers and JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEOUL = "Asia/Seoul"

# Listing exchange -> trading currency.
EXCHANGE_CURRENCY = {
    "NASD": "USD",
    "NYSE": "USD",
    "AMEX": "USD",
    "SEHK": "HKD",
    "SHAA": "CNY",
    "SZAA": "CNY",
    "TKSE": "JPY",
    "HASE": "VND",
    "VNSE": "VND",
}
DEFAULT_CURRENCY = "USD"


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_filled(*texts: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[blank_to_null(text) for text in texts])


def parse_day(text: Column) -> Column:
    """Date from `YYYYMMDD`; anything else is NULL."""
    return F.try_to_date(text, "yyyyMMdd")


def parse_day_or_iso(text: Column) -> Column:
    """Date from `YYYYMMDD` or `YYYY-MM-DD`."""
    return parse_day(F.replace(text, F.lit("-"), F.lit("")))


def seoul_time(utc: Column) -> Column:
    """Wall clock in Seoul of a zone-less UTC timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(SEOUL), utc.cast("timestamp_ntz"))


def seoul_day(utc: Column) -> Column:
    return seoul_time(utc).cast("date")


def resolve_day(token: Column, now_utc: Column) -> Column:
    """Date of a batch token: `today` (or nothing) is the Seoul date of `now_utc`, else `YYYYMMDD`."""
    word = F.lower(F.trim(F.coalesce(blank_to_null(token), F.lit("today"))))
    return F.when(word == "today", seoul_day(now_utc)).otherwise(parse_day(word))


def yes_no(text: Column) -> Column:
    """Y/N (or true/false) to boolean, anything else NULL."""
    word = F.upper(text)
    return F.when(word.isin("Y", "TRUE"), True).when(word.isin("N", "FALSE"), False)


def mask(number: Column) -> Column:
    """First two and last two characters with stars between; all stars up to four characters."""
    length = F.length(number)
    return F.when(length <= 4, F.repeat(F.lit("*"), length)).otherwise(
        F.concat(F.substring(number, 1, 2), F.repeat(F.lit("*"), length - 4), F.right(number, F.lit(2)))
    )


def exchange_currency(exchange: Column) -> Column:
    """Trading currency of an exchange, USD when it is not listed."""
    lookup = F.create_map(*[F.lit(item) for pair in EXCHANGE_CURRENCY.items() for item in pair])
    return F.coalesce(F.try_element_at(lookup, exchange), F.lit(DEFAULT_CURRENCY))


def iso_day(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def iso_time(ts: Column) -> Column:
    """`YYYY-MM-DDTHH:MM:SS`, with microseconds only when there are some."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def encode_json(value: Column) -> Column:
    """JSON text of a struct, map, array or variant; NULL fields are kept as `null`."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def decode_json(text: Column) -> Column:
    """Variant of a JSON text. Text that is not JSON is kept, as a variant string."""
    return F.coalesce(F.try_parse_json(text), text.cast("variant"))
