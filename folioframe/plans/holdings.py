"""Holdings: exposure of domestic ones, KRW value of overseas ones, and cash that is left over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import numbers
from folioframe.functions.classify import EXPOSURES, Keywords, classify
from folioframe.plans.portfolio import residual
from folioframe.sources.masters import DEFAULT_MARKET

# Names of the rows that stand for cash and for the rest of a list.
DOMESTIC_CASH, OVERSEAS_CASH = "국내 예수금/현금성", "해외 예수금/현금성"
OTHER_OVERSEAS = "기타 해외주식"

# Lines that a task joins and sums, and from how many on they are dealt by count.
TASK_ROWS, DEALT_FROM = 250_000, 4_000_000

HOLDING_COLUMNS = (
    "account_label", "account_type", "symbol", "name", "market", "basis_category", "exposure_type",
    "exposure_region", "asset_subtype", "confidence", "quantity", "value_krw", "value_foreign", "currency",
    "raw_data",
)


def account_values(latest: DataFrame, accounts: DataFrame, by: list[str]) -> DataFrame:
    """Latest account rows with their label, display name and masked number.

    An account that is not configured goes by its type. Spark measures `accounts` and broadcasts it only under
    its size threshold.
    """
    names = accounts.select("account_id", "label", "display_name", "masked_number")
    fallback = F.coalesce("account_type", F.lit("unknown"))
    return latest.join(names, "account_id", "left").select(
        *by, "account_id",
        F.coalesce("label", fallback).alias("account_label"),
        F.coalesce("display_name", "label", fallback).alias("display_name"),
        "masked_number", "snapshot_at",
        F.coalesce("total_eval_amt", F.lit(0)).alias("value_krw"),
    )


def instrument_facts(master: DataFrame, overrides: DataFrame, market: str = DEFAULT_MARKET) -> DataFrame:
    """Group code and manual override per symbol, so that holdings need one join instead of two."""
    manual = F.struct("exposure_type", "exposure_region", "asset_subtype").alias("override")
    rows = master.filter(F.col("market") == market).select("symbol", "group_code").unionByName(
        overrides.filter(F.col("market") == market).select("symbol", manual), allowMissingColumns=True
    )
    return rows.groupBy("symbol").agg(
        F.max("group_code").alias("group_code"), F.max("override").alias("override")
    )


def classify_holdings(holdings: DataFrame, master: DataFrame, overrides: DataFrame,
                      words: Keywords = Keywords()) -> DataFrame:
    """Domestic holdings with exposure, region, subtype, confidence, source and warning.

    Spark broadcasts the instrument facts when they are under its size threshold; beyond it the sort-merge
    join splits symbols that hold too many rows (adaptive skew join).
    """
    facts = instrument_facts(master, overrides)
    classified = holdings.join(facts, "symbol", "left").withColumn(
        "_class", classify(F.col("name"), F.col("group_code"), F.col("override"), words)
    )
    return classified.select(*holdings.columns, "_class.*")


def dealt(rows: DataFrame, total: int, *keys: str) -> DataFrame:
    """Rows dealt by `keys` to so many tasks that each gets about TASK_ROWS of the `total`.

    Spark's number of shuffle partitions does not grow with a table, so a task's share, and the memory that it sorts and
    sums it in, would. What is joined or summed by the keys next is not shuffled again, if a joined side is dealt by
    the same total. Below DEALT_FROM rows Spark's own choice stays.
    """
    return rows if total < DEALT_FROM else rows.repartition(-(-total // TASK_ROWS), *keys)


def value_overseas(holdings: DataFrame, rates: DataFrame, by: list[str]) -> DataFrame:
    """Overseas holdings in KRW, cut to whole units; without a usable rate the value is NULL."""
    usable = rates.select(*by, "currency", F.col("rate").alias("fx_rate")).filter(F.col("fx_rate") != 0)
    return holdings.join(usable, [*by, "currency"], "left").withColumn(
        "value_krw", numbers.truncate(F.col("value_foreign") * F.col("fx_rate"))
    )


def by_currency(valued: DataFrame, by: list[str]) -> DataFrame:
    """Value per currency, in it and in KRW, with the rate."""
    krw = numbers.truncate(F.sum(F.col("value_foreign") * F.col("fx_rate")))
    return valued.groupBy(*by, "currency").agg(
        F.round(F.sum("value_foreign"), 2).alias("value_foreign"),
        F.max("fx_rate").alias("fx_rate"),
        F.nullif(krw, F.lit(0)).alias("value_krw"),
    )


def exposure_sums(prefix: str = "") -> list[Column]:
    """One sum per exposure, 0 where there is none."""
    return [
        F.coalesce(F.sum(F.when(F.col("exposure_type") == name, F.col("value_krw"))), F.lit(0)).alias(prefix + name)
        for name in EXPOSURES
    ]


def exposure_amounts(classified: DataFrame, by: list[str]) -> DataFrame:
    """Amounts of the five exposures as columns."""
    return classified.groupBy(*by).agg(*exposure_sums())


def account_key(values: DataFrame, holdings: DataFrame) -> str:
    """What tells accounts apart: their id where both sides have it. Labels may be shared, as accounts that are not
    configured go by their type."""
    return "account_id" if "account_id" in values.columns and "account_id" in holdings.columns else "account_label"


def owned(holdings: DataFrame, values: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Holdings of accounts that have a value, and the others: an overview walks the valued accounts, so a holding of
    another one is a reject and counts nowhere."""
    keys = [*by, account_key(values, holdings)]
    valued = values.select(*keys).distinct()
    return holdings.join(valued, keys, "left_semi"), holdings.join(valued, keys, "left_anti")


def account_positions(values: DataFrame, classified: DataFrame, by: list[str]) -> DataFrame:
    """Per account its value, its holdings in all and per exposure, and the cash left over.

    Values and holdings are stacked and summed together: one shuffle after partial sums, and no join that a
    large account could skew. An account that has only holdings is left out.
    """
    key = account_key(values, classified)
    keys = [*by, key]
    named = [*keys, *(["account_label"] if key != "account_label" else [])]
    stacked = values.select(*named, F.col("value_krw").alias("account_krw")).unionByName(
        classified.select(*keys, "value_krw", "exposure_type"), allowMissingColumns=True
    )
    label = [F.max("account_label").alias("account_label")] if key != "account_label" else []
    return stacked.groupBy(*keys).agg(
        *label,
        F.coalesce(F.sum("account_krw"), F.lit(0)).alias("account_krw"),
        F.coalesce(F.sum("value_krw"), F.lit(0)).alias("holdings_krw"),
        F.count("account_krw").alias("accounts"),
        *exposure_sums("dom_"),
    ).filter("accounts > 0").withColumn("residual_krw", residual(F.col("account_krw"), F.col("holdings_krw")))


def _text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def residual_cash_rows(positions: DataFrame, by: list[str]) -> DataFrame:
    """A cash holding for every account whose value exceeds its holdings."""
    facts = F.struct(F.col("account_krw").alias("account_total"), F.col("holdings_krw").alias("holdings_total"))
    return positions.filter(F.col("residual_krw") > 0).select(
        *by, "account_label", F.col("account_label").alias("account_type"),
        *_cash_columns(DOMESTIC_CASH, "KRW", "kr", F.col("residual_krw")), F.to_json(facts).alias("raw_data"),
    )


def _cash_columns(name: str, market: str, region: str, amount: Column) -> list[Column]:
    return [
        _text(None).alias("symbol"), _text(name).alias("name"), _text(market).alias("market"),
        _text("cash").alias("basis_category"), _text("cash").alias("exposure_type"),
        _text(region).alias("exposure_region"), _text("cash").alias("asset_subtype"),
        _text("high").alias("confidence"), F.lit(None).cast("double").alias("quantity"),
        amount.alias("value_krw"), F.lit(None).cast("double").alias("value_foreign"),
        _text("KRW").alias("currency"),
    ]


def domestic_rows(classified: DataFrame, by: list[str]) -> DataFrame:
    """Classified domestic holdings in the shape of the holding fact."""
    return classified.withColumns({
        "account_type": F.col("account_label"), "market": _text(DEFAULT_MARKET),
        "basis_category": _text("domestic_account"), "value_foreign": F.lit(None).cast("double"),
        "currency": _text("KRW"),
    }).select(*by, *HOLDING_COLUMNS)


def overseas_rows(valued: DataFrame, by: list[str]) -> DataFrame:
    """Valued overseas holdings in the shape of the holding fact."""
    return valued.withColumns({
        "account_type": F.col("account_label"), "market": F.col("exchange"),
        "basis_category": _text("overseas_account"), "exposure_type": _text("overseas_direct"),
        "exposure_region": F.col("currency"), "asset_subtype": _text("equity"), "confidence": _text("high"),
        "value_foreign": F.round("value_foreign", 2),
    }).select(*by, *HOLDING_COLUMNS)


def overseas_cash_rows(summary: DataFrame, by: list[str], deposits: DataFrame | None = None) -> DataFrame:
    """A cash holding for every overview with overseas cash, and the raw deposit it was read from, if `deposits`
    holds `by` and `deposit_data`."""
    label = F.col("overseas_account_label")
    rows = summary.filter(F.col("overseas_cash_amt_krw") > 0)
    raw = _text(None)
    if deposits is not None:
        rows = rows.join(deposits.groupBy(*by).agg(F.min("deposit_data").alias("_deposit")), by, "left")
        raw = F.col("_deposit")
    return rows.select(
        *by, label.alias("account_label"), label.alias("account_type"),
        *_cash_columns(OVERSEAS_CASH, "FX", "global", F.col("overseas_cash_amt_krw")),
        raw.alias("raw_data"),
    )


def warnings(classified: DataFrame, by: list[str]) -> DataFrame:
    """Holdings whose exposure could not be told, with the reason."""
    return classified.filter(F.col("warning").isNotNull()).select(
        *by, "account_label", "symbol", "name", F.col("warning").alias("reason"), "confidence", "source"
    )
