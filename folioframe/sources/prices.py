"""Price and exchange-rate responses to typed rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import numbers, payload, text

DOMESTIC_EXCHANGE = "KRX"


class PriceFields(NamedTuple):
    """Member names in one response format; several dates are tried in order."""

    dates: tuple[str, ...]
    open: str
    high: str
    low: str
    close: str
    volume: str


# Member names of the two price formats and of the rate format.
DOMESTIC_FIELDS = PriceFields(
    ("stck_bsop_date", "stck_clpr_date"), "stck_oprc", "stck_hgpr", "stck_lwpr", "stck_clpr", "acml_vol"
)
OVERSEAS_FIELDS = PriceFields(("xymd",), "open", "high", "low", "clos", "tvol")
RATE_DATES = ("stck_bsop_date", "xymd")
RATE_VALUES = ("ovrs_nmix_prpr", "clos")


_VALUES = ("open", "high", "low", "close", "volume")


def _price_rows(responses: DataFrame, texts: Column, fields: PriceFields, exchange: Column) -> DataFrame:
    row = payload.Members(*fields.dates, *[getattr(fields, name) for name in _VALUES], zero_is_missing=True)
    carried = [name for name in responses.columns if name not in ("symbol", "exchange", "payload")]
    return row.explode(responses, texts).select(
        "symbol",
        exchange.alias("exchange"),
        F.coalesce(*[row.get(name) for name in fields.dates]).alias("date"),
        *[row.get(getattr(fields, name)).alias(name) for name in _VALUES],
        *carried,
    ).filter(F.col("date").isNotNull())


def domestic_price_rows(responses: DataFrame) -> DataFrame:
    """`(symbol, payload)` responses to one text row per trading day on the domestic exchange.

    Other columns (a sequence, say) are carried along. Rows without a date are dropped.
    """
    texts = payload.first_list(F.col("payload"), "output2", "output")
    return _price_rows(responses, texts, DOMESTIC_FIELDS, F.lit(DOMESTIC_EXCHANGE))


def overseas_price_rows(responses: DataFrame) -> DataFrame:
    """As `domestic_price_rows` for `(symbol, exchange, payload)` of foreign exchanges."""
    return _price_rows(responses, payload.items(F.col("payload"), "output2"), OVERSEAS_FIELDS, F.col("exchange"))


def rate_rows(responses: DataFrame) -> DataFrame:
    """`(currency, period, payload)` to `(currency, period, date, rate)` text rows having both values."""
    row = payload.Members(*RATE_DATES, typed=RATE_VALUES)
    carried = [name for name in responses.columns if name not in ("currency", "period", "payload")]
    return row.explode(responses, payload.items(F.col("payload"), "output2")).select(
        "currency",
        "period",
        F.coalesce(*[row.get(name) for name in RATE_DATES]).alias("date"),
        F.coalesce(*[row.nonzero(name) for name in RATE_VALUES]).alias("rate"),
        *carried,
    ).filter(F.col("date").isNotNull() & F.col("rate").isNotNull())


def typed_prices(rows: DataFrame) -> DataFrame:
    """Text price rows to the stored types. A date that does not parse stays, as NULL, for `merge.split_bad`."""
    return rows.withColumns({
        "date": text.parse_day(F.col("date")),
        **{name: numbers.strict_float(F.col(name)) for name in ("open", "high", "low", "close")},
        "volume": numbers.strict_int(F.col("volume")),
    })


def typed_rates(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "currency": F.upper("currency"),
        "date": text.parse_day(F.col("date")),
        "rate": numbers.strict_float(F.col("rate")),
    })
