"""Rows for the append-only tables: always inserted, each with an id of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import variants
from folioframe.functions.text import encode_json, parse_day
from folioframe.operators.tables import conform
from folioframe.schemas import TABLES


def _row_id() -> Column:
    return F.uuid()


def _stamped(rows: DataFrame, table: str, time: str, at: Column | None) -> DataFrame:
    """Give each row an id and a time where it has none.

    Random ids change when a plan is run again: write the result, and read it back before using the ids.
    """
    if "id" not in rows.columns:
        rows = rows.withColumn("id", _row_id())
    if time not in rows.columns:
        rows = rows.withColumn(time, F.localtimestamp() if at is None else at)
    return conform(rows, TABLES[table])


def portfolio_snapshots(rows: DataFrame, at: Column | None = None) -> DataFrame:
    """Account value and raw response."""
    return _stamped(rows, "portfolio_snapshots", "snapshot_at", at)


def overseas_snapshots(rows: DataFrame, at: Column | None = None) -> DataFrame:
    """Stock, cash and total amounts with the rates, balance and deposit they came from, encoded as JSON."""
    encoded = {name: encode_json(F.col(name)) for name in ("fx_data", "balance_data", "deposit_data")
               if name in rows.columns and rows.schema[name].dataType.typeName() != "string"}
    return _stamped(rows.withColumns(encoded) if encoded else rows, "overseas_asset_snapshots",
                    "snapshot_at", at)


def overview_snapshots(summary: DataFrame, at: Column | None = None) -> DataFrame:
    """Flat amounts of overview summaries plus allocation, classification and the whole overview as JSON.

    The last two come from the columns `classification` and `document` of `overview.documents`; a bare summary gives
    its exposure amounts and itself.
    """
    shares = ["domestic_pct", "overseas_pct", "overseas_stock_pct", "overseas_cash_pct"]
    exposures = [name for name in summary.columns if name in (
        "domestic_direct_amt_krw", "overseas_direct_amt_krw", "overseas_indirect_amt_krw", "cash_amt_krw",
        "unknown_amt_krw")]
    rows = summary.withColumns({
        "base_currency": F.lit("KRW"),
        "allocation_data": encode_json(F.struct(*shares)),
        "classification_summary": F.col("classification") if "classification" in summary.columns
        else encode_json(F.struct(*exposures)),
        "overview_data": F.col("document") if "document" in summary.columns
        else encode_json(F.struct(*summary.columns)),
    })
    return _stamped(rows, "asset_overview_snapshots", "snapshot_at", at)


def holding_snapshots(holdings: DataFrame, at: Column | None = None) -> DataFrame:
    """One row per holding, tied to its overview by `overview_snapshot_id`."""
    return _stamped(holdings, "asset_holding_snapshots", "snapshot_at", at)


def _reports(rows: DataFrame, table: str, at: Column | None) -> DataFrame:
    days = {name: parse_day(F.col(name)) for name in ("start_date", "end_date")
            if rows.schema[name].dataType.typeName() == "string"}
    return _stamped(rows.withColumns(days) if days else rows, table, "fetched_at", at)


def profit_reports(rows: DataFrame, at: Column | None = None) -> DataFrame:
    """Raw profit reports by account, market type and date range."""
    return _reports(rows, "trade_profit_history", at)


def order_observations(rows: DataFrame, at: Column | None = None) -> DataFrame:
    """Raw order-list responses by account, product and date range."""
    return _reports(rows, "order_history", at)


def documents(rows: DataFrame, column: str) -> DataFrame:
    """Raw responses parsed as they are stored: `doc`, the text of `column` as VARIANT, in its place. Readers then take
    members from the parsed form, however often the rows are read. What does not parse keeps its text in `unread`."""
    doc = variants.parsed(F.col(column))
    read = rows.withColumn("doc", doc)
    return read.withColumn("unread", F.when(F.col("doc").isNull(), F.col(column))).drop(column)
