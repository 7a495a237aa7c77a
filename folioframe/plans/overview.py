"""Total-asset overview of any number of owners or snapshots in one pass.

`by` names the columns that identify one overview (an owner, say, or an owner and a day). Every input carries
them; every output is keyed by them.
"""

from __future__ import annotations

from typing import Callable, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import limits, numbers
from folioframe.functions.classify import EXPOSURES, Keywords
from folioframe.operators import rank
from folioframe.plans import holdings as H

# Chart labels and source names.
DOMESTIC_ASSETS, OVERSEAS_ASSETS = "국내자산", "해외자산"
OVERSEAS_STOCK = "해외주식"
BASIS_LABELS = ("국내계좌 보유자산", "해외계좌 보유자산", "현금성")
EXPOSURE_LABELS = {
    "domestic_direct": "국내직접",
    "overseas_direct": "해외직접",
    "overseas_indirect": "해외우회투자",
    "cash": "현금성",
    "unknown": "분류필요",
}
TOTAL_FROM_DEPOSIT = "overseas_deposit.예수금_총계.총자산금액"
TOTAL_FROM_PARTS = "stock_eval_plus_deposit_cash_fields"


class OverseasValuation(NamedTuple):
    totals: DataFrame
    by_currency: DataFrame
    top: DataFrame


class Overview(NamedTuple):
    """Lazy results. `holdings` and `summary` share inputs: write one before deriving the other at scale."""

    summary: DataFrame
    holdings: DataFrame
    accounts: DataFrame
    charts: DataFrame
    top: DataFrame
    warnings: DataFrame
    rejects: DataFrame


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _overseas_measures(valued: DataFrame, cash: DataFrame, by: list[str]) -> DataFrame:
    """Holdings and deposits stacked, ready to be folded per overview.

    Holdings are summed by account before that: numbers alone hash, where folding the label text with them
    would sort every holding.
    """
    sums = valued.groupBy(*by, F.col("account_label").alias("overseas_account_label")).agg(
        F.sum("value_krw").alias("stock_krw"), F.count(F.lit(1)).alias("overseas_holding")
    )
    return sums.unionByName(
        cash.select(
            *by, F.col("account_label").alias("overseas_account_label"),
            F.col("total_asset_amt_krw").alias("reported_krw"), F.col("cash_from_fields_amt_krw").alias("cash_krw"),
        ),
        allowMissingColumns=True,
    )


_OVERSEAS_SUMS = {
    "overseas_account_label": F.max, "stock_krw": F.sum, "reported_krw": F.sum, "cash_krw": F.sum,
    "overseas_holding": F.sum,
}


def _overseas_aggregates() -> list[Column]:
    return [fold(name).alias(name) for name, fold in _OVERSEAS_SUMS.items()]


def _overseas_totals(sums: DataFrame) -> DataFrame:
    """Stock, cash and total. The reported total counts unless it is missing or 0; then stock and cash."""
    stock = _zero("stock_krw")
    total = F.coalesce(F.nullif(F.col("reported_krw"), F.lit(0)), stock + _zero("cash_krw"))
    return sums.withColumns({
        "overseas_stock_eval_amt_krw": stock,
        "overseas_total_asset_amt_krw": total,
        "overseas_cash_amt_krw": F.greatest(total - stock, F.lit(0)),
        "overseas_holdings_count": _zero("overseas_holding"),
        "total_asset_source": F.when(F.col("reported_krw").isNotNull(), TOTAL_FROM_DEPOSIT)
        .otherwise(TOTAL_FROM_PARTS),
    }).drop("stock_krw", "reported_krw", "cash_krw", "overseas_holding")


def overseas_valuation(holdings: DataFrame, cash: DataFrame, rates: DataFrame, by: list[str],
                       top_n: int = 10) -> OverseasValuation:
    """Totals, value by currency and the largest holdings with the rest in one row.

    `holdings` is `balances.overseas_holdings`, `cash` is `balances.cash_summary`, both with account_label;
    `rates` is `balances.fx_rates`.
    """
    valued = H.value_overseas(holdings, rates, by)
    totals = _overseas_totals(_overseas_measures(valued, cash, by).groupBy(*by).agg(*_overseas_aggregates()))
    return OverseasValuation(totals, H.by_currency(valued, by), _top_holdings(valued, totals, by, top_n))


def _top_holdings(valued: DataFrame, totals: DataFrame, by: list[str], top_n: int) -> DataFrame:
    """Largest holdings with their shares of the overseas stock, the overseas total and, where `totals` has
    it, the total of all assets."""
    label = F.coalesce("symbol", "name", F.lit("unknown"))
    rows = valued.withColumns({"label": label, "value_foreign": F.round("value_foreign", 2)})
    # Holdings that tie in all of these are listed alike, whichever comes first.
    ties = ["label", "exchange", "currency", "value_foreign", "quantity"]
    top = rank.top_with_other(rows, by, "value_krw", "label", limits.top_n(top_n), H.OTHER_OVERSEAS, ties,
                              ("value_foreign", "currency"))
    shares = {
        "pct_of_overseas_stock": "overseas_stock_eval_amt_krw",
        "pct_of_overseas_total": "overseas_total_asset_amt_krw",
        "pct_of_total": "total_eval_amt_krw",
    }
    known = {name: whole for name, whole in shares.items() if whole in totals.columns}
    return top.join(totals.select(*by, *known.values()), by).select(
        *by, "place", "label", F.col("value").alias("value_krw"), "value_foreign", "currency",
        *[numbers.pct(F.col("value"), F.col(whole)).alias(name) for name, whole in known.items()],
    )


def summarize(positions: DataFrame, valued: DataFrame, cash: DataFrame, by: list[str]) -> DataFrame:
    """One row per overview: totals, allocation percentages and exposure amounts.

    Account positions and overseas measures are stacked and folded by one aggregate, so no side needs a row
    for every overview.
    """
    dom = {name: f"dom_{name}" for name in EXPOSURES}
    stacked = positions.select(
        *by, "account_krw", "holdings_krw", "residual_krw", "accounts", *dom.values()
    ).unionByName(_overseas_measures(valued, cash, by), allowMissingColumns=True)
    sums = stacked.groupBy(*by).agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name)
          for name in ("account_krw", "holdings_krw", "residual_krw", "accounts", *dom.values())],
        *_overseas_aggregates(),
    )
    rows = _overseas_totals(sums).withColumn("domestic_eval_amt_krw", F.col("account_krw")).withColumn(
        "total_eval_amt_krw", F.col("account_krw") + F.col("overseas_total_asset_amt_krw")
    )
    amounts = {
        "domestic_direct": F.col("dom_domestic_direct"),
        "overseas_direct": F.col("dom_overseas_direct") + F.col("overseas_stock_eval_amt_krw"),
        "overseas_indirect": F.col("dom_overseas_indirect"),
        "cash": F.col("dom_cash") + F.col("residual_krw") + F.col("overseas_cash_amt_krw"),
        "unknown": F.col("dom_unknown"),
    }
    total = F.col("total_eval_amt_krw")
    return rows.select(
        *by, "domestic_eval_amt_krw", "overseas_stock_eval_amt_krw", "overseas_cash_amt_krw",
        "overseas_total_asset_amt_krw", "total_eval_amt_krw",
        numbers.pct(F.col("domestic_eval_amt_krw"), total).alias("domestic_pct"),
        numbers.pct(F.col("overseas_total_asset_amt_krw"), total).alias("overseas_pct"),
        numbers.pct(F.col("overseas_stock_eval_amt_krw"), total).alias("overseas_stock_pct"),
        numbers.pct(F.col("overseas_cash_amt_krw"), total).alias("overseas_cash_pct"),
        *[amount.alias(f"{name}_amt_krw") for name, amount in amounts.items()],
        F.col("holdings_krw").alias("domestic_non_cash_amt_krw"),
        F.col("accounts").alias("account_count"), "overseas_account_label", "overseas_holdings_count",
        "total_asset_source",
    )


def account_split(positions: DataFrame, values: DataFrame, summary: DataFrame, by: list[str]) -> DataFrame:
    """Value and share per domestic account, and one row for the overseas account.

    Positions and names come out of aggregates on the same keys, so they meet without another shuffle.
    """
    total = F.col("total_eval_amt_krw")
    keys = [*by, "account_id" if "account_id" in positions.columns else "account_label"]
    names = values.groupBy(*keys).agg(F.max("display_name").alias("label"))
    shares = positions.join(names, keys).join(summary.select(*by, "total_eval_amt_krw"), by).select(
        *by, "account_label", "label", F.col("account_krw").alias("value_krw"),
        numbers.pct(F.col("account_krw"), total).alias("pct"),
    )
    overseas = F.col("overseas_total_asset_amt_krw")
    return shares.unionByName(summary.select(
        *by, F.col("overseas_account_label").alias("account_label"), F.lit(OVERSEAS_ASSETS).alias("label"),
        overseas.alias("value_krw"), numbers.pct(overseas, total).alias("pct"),
    ))


def charts(summary: DataFrame, by: list[str]) -> DataFrame:
    """Chart series of an overview as rows: chart, place, label, key, value, share of total, share of part."""
    total, overseas = F.col("total_eval_amt_krw"), F.col("overseas_total_asset_amt_krw")
    rows = []

    def add(chart: str, label: str, value: Column, key: str | None = None, part: Column | None = None) -> None:
        place = 1 + sum(1 for row in rows if row[0] == chart)
        share = numbers.pct(value, part) if part is not None else F.lit(None).cast("double")
        rows.append((chart, F.struct(
            F.lit(chart).alias("chart"), F.lit(place).alias("place"), F.lit(label).alias("label"),
            F.lit(key).cast("string").alias("key"), value.alias("value_krw"),
            numbers.pct(value, total).alias("pct"), share.alias("pct_of_part"),
        )))

    add("domestic_vs_overseas", DOMESTIC_ASSETS, F.col("domestic_eval_amt_krw"))
    add("domestic_vs_overseas", OVERSEAS_ASSETS, overseas)
    stock, cash = F.col("overseas_stock_eval_amt_krw"), F.col("overseas_cash_amt_krw")
    add("overseas_stock_vs_cash", OVERSEAS_STOCK, stock, part=overseas)
    add("overseas_stock_vs_cash", H.OVERSEAS_CASH, cash, part=overseas)
    basis = (F.col("domestic_non_cash_amt_krw"), stock, F.col("cash_amt_krw"))
    for label, value in zip(BASIS_LABELS, basis):
        add("by_account_basis", label, value)
    for key, label in EXPOSURE_LABELS.items():
        add("by_economic_exposure", label, F.col(f"{key}_amt_krw"), key)
    return summary.select(*by, F.inline(F.array(*[row for _, row in rows])))


def total_asset_overview(values: DataFrame, domestic: DataFrame, overseas: DataFrame, cash: DataFrame,
                         rates: DataFrame, master: DataFrame, overrides: DataFrame, by: list[str],
                         top_n: int = 10, words: Keywords = Keywords(), deposits: DataFrame | None = None,
                         keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> Overview:
    """Domestic accounts and overseas account together.

    `values` is `holdings.account_values`; `domestic` the exploded holdings of the same snapshots with
    account_label, and account_id where accounts may share a label; `overseas`, `cash` and `rates` as in
    `overseas_valuation`. A missing overseas response is an empty side: its amounts are 0 and the other totals stand.
    Domestic holdings of accounts without a value go to `rejects`. `deposits` (`by` and `deposit_data`, the raw
    responses) are kept on the overseas cash rows. `keep` is given what several results share, with a name, and may
    write it: left as it is, each result makes it anew.
    """
    domestic, rejects = H.owned(domestic, values, by)
    classified = keep(H.classify_holdings(domestic, master, overrides, words), "classified")
    valued = keep(H.value_overseas(overseas, rates, by), "valued")
    positions = keep(H.account_positions(values, classified, by), "positions")
    summary = keep(summarize(positions, valued, cash, by), "summary")
    rows = (
        H.domestic_rows(classified, by)
        .unionByName(H.residual_cash_rows(positions, by))
        .unionByName(H.overseas_rows(valued, by))
        .unionByName(H.overseas_cash_rows(summary, by, deposits))
    )
    return Overview(
        summary, rows, account_split(positions, values, summary, by), charts(summary, by),
        _top_holdings(valued, summary, by, top_n), H.warnings(classified, by), rejects,
    )


def documents(overview: Overview, by: list[str]) -> DataFrame:
    """The summary with what is stored of an overview as JSON: `classification` (amounts per exposure, the splits by
    account basis and by exposure, and the warnings) and `document` (totals, domestic accounts, the overseas part with
    its largest holdings, and all chart series).

    An overview's accounts, charts and warnings are a handful of rows of one owner; they meet by its key.
    """
    def rows(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))

    charts = rows(overview.charts, "charts", "chart", "place", "label", "key", "value_krw", "pct", "pct_of_part")
    accounts = rows(overview.accounts, "accounts", "account_label", "label", "value_krw", "pct")
    top = rows(overview.top, "top_holdings", "place", "label", "value_krw", "value_foreign", "currency")
    warned = rows(overview.warnings, "warnings", "account_label", "symbol", "name", "reason", "confidence")
    joined = overview.summary
    for part in (charts, accounts, top, warned):
        joined = joined.join(part, by, "left")

    def series(name: str) -> Column:
        return F.filter("charts", lambda row: row["chart"] == name)

    amounts = F.struct(*[f"{name}_amt_krw" for name in EXPOSURE_LABELS])
    classification = F.struct(
        amounts.alias("amounts"), series("by_account_basis").alias("account_basis"),
        series("by_economic_exposure").alias("economic_exposure"), F.col("warnings"))
    document = F.struct(
        F.struct(*overview.summary.columns).alias("summary"),
        F.struct("domestic_eval_amt_krw", "accounts").alias("domestic"),
        F.struct("overseas_stock_eval_amt_krw", "overseas_cash_amt_krw", "overseas_total_asset_amt_krw",
                 "total_asset_source", "top_holdings").alias("overseas"),
        F.col("charts"))
    return joined.select(
        *overview.summary.columns, F.to_json(classification).alias("classification"), F.to_json(document).alias("document"))


def inconsistent(summary: DataFrame) -> DataFrame:
    """Overviews whose parts do not add up: total against domestic and overseas, overseas against stock and
    cash. The second can fail when holdings exceed the reported total."""
    total = F.col("domestic_eval_amt_krw") + F.col("overseas_total_asset_amt_krw")
    overseas = F.col("overseas_stock_eval_amt_krw") + F.col("overseas_cash_amt_krw")
    return summary.filter(
        (F.col("total_eval_amt_krw") != total) | (F.col("overseas_total_asset_amt_krw") != overseas)
    )
