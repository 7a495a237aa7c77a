"""Column types, keys and parts of the twelve stored tables."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

STRING, LONG, DOUBLE = StringType(), LongType(), DoubleType()
BOOLEAN, DATE, TIME = BooleanType(), DateType(), TimestampNTZType()


def key(name: str, kind: DataType) -> StructField:
    """A column that is never NULL."""
    return StructField(name, kind, nullable=False)


def col(name: str, kind: DataType) -> StructField:
    return StructField(name, kind)


PRICE_HISTORY = StructType([
    key("symbol", STRING),
    key("exchange", STRING),
    key("date", DATE),
    col("open", DOUBLE),
    col("high", DOUBLE),
    col("low", DOUBLE),
    col("close", DOUBLE),
    col("volume", LONG),
    col("adjusted", BOOLEAN),
    col("created_at", TIME),
])

EXCHANGE_RATE_HISTORY = StructType([
    key("currency", STRING),
    key("date", DATE),
    key("period", STRING),
    col("rate", DOUBLE),
    col("created_at", TIME),
])

PORTFOLIO_SNAPSHOTS = StructType([
    key("id", STRING),
    key("account_id", STRING),
    key("account_type", STRING),
    key("snapshot_at", TIME),
    col("total_eval_amt", LONG),
    col("balance_data", STRING),
])

OVERSEAS_ASSET_SNAPSHOTS = StructType([
    key("id", STRING),
    key("account_id", STRING),
    key("account_type", STRING),
    key("snapshot_at", TIME),
    col("stock_eval_amt_krw", LONG),
    col("cash_amt_krw", LONG),
    col("total_asset_amt_krw", LONG),
    col("fx_data", STRING),
    col("balance_data", STRING),
    col("deposit_data", STRING),
])

ASSET_OVERVIEW_SNAPSHOTS = StructType([
    key("id", STRING),
    key("snapshot_at", TIME),
    key("base_currency", STRING),
    col("domestic_eval_amt_krw", LONG),
    col("overseas_stock_eval_amt_krw", LONG),
    col("overseas_cash_amt_krw", LONG),
    col("overseas_total_asset_amt_krw", LONG),
    col("total_eval_amt_krw", LONG),
    col("domestic_pct", DOUBLE),
    col("overseas_pct", DOUBLE),
    col("overseas_stock_pct", DOUBLE),
    col("overseas_cash_pct", DOUBLE),
    col("domestic_direct_amt_krw", LONG),
    col("overseas_direct_amt_krw", LONG),
    col("overseas_indirect_amt_krw", LONG),
    col("cash_amt_krw", LONG),
    col("unknown_amt_krw", LONG),
    col("allocation_data", STRING),
    col("classification_summary", STRING),
    col("overview_data", STRING),
])

ASSET_HOLDING_SNAPSHOTS = StructType([
    key("id", STRING),
    key("overview_snapshot_id", STRING),
    key("snapshot_at", TIME),
    col("account_label", STRING),
    col("account_type", STRING),
    col("symbol", STRING),
    col("name", STRING),
    col("market", STRING),
    col("basis_category", STRING),
    col("exposure_type", STRING),
    col("exposure_region", STRING),
    col("asset_subtype", STRING),
    col("confidence", STRING),
    col("quantity", DOUBLE),
    col("value_krw", LONG),
    col("value_foreign", DOUBLE),
    col("currency", STRING),
    col("raw_data", STRING),
])

MARKET_CALENDAR = StructType([
    key("market", STRING),
    key("trade_date", DATE),
    key("is_open", BOOLEAN),
    col("open_time_local", STRING),
    col("close_time_local", STRING),
    key("timezone", STRING),
    col("source", STRING),
    col("note", STRING),
    col("raw_data", STRING),
    key("updated_at", TIME),
])

INSTRUMENT_MASTER = StructType([
    key("symbol", STRING),
    key("market", STRING),
    col("standard_code", STRING),
    col("name", STRING),
    col("group_code", STRING),
    col("etp_code", STRING),
    col("idx_large_code", STRING),
    col("idx_mid_code", STRING),
    col("idx_small_code", STRING),
    col("raw_data", STRING),
    key("updated_at", TIME),
])

CLASSIFICATION_OVERRIDES = StructType([
    key("symbol", STRING),
    key("market", STRING),
    key("exposure_type", STRING),
    col("exposure_region", STRING),
    col("asset_subtype", STRING),
    col("reason", STRING),
    key("updated_at", TIME),
])

DOMESTIC_ORDERS = StructType([
    key("account_id", STRING),
    key("account_product_code", STRING),
    key("account_type", STRING),
    key("order_date", DATE),
    key("order_branch_no", STRING),
    key("order_no", STRING),
    col("original_order_no", STRING),
    col("symbol", STRING),
    col("symbol_name", STRING),
    col("side_code", STRING),
    col("side_name", STRING),
    col("order_type_code", STRING),
    col("order_type_name", STRING),
    col("order_time", STRING),
    col("order_qty", LONG),
    col("total_order_qty", LONG),
    col("order_price", LONG),
    col("avg_price", LONG),
    col("filled_qty", LONG),
    col("filled_amount", LONG),
    col("pending_qty", LONG),
    col("cancel_confirm_qty", LONG),
    col("rejected_qty", LONG),
    col("is_cancelled", BOOLEAN),
    col("condition_name", STRING),
    col("exchange_id_code", STRING),
    col("order_orgno", STRING),
    key("first_seen_at", TIME),
    key("last_seen_at", TIME),
    # What the stored observation was ordered by, so that an older one does not write over it.
    col("last_observed_at", TIME),
    col("last_observed_place", LONG),
    col("last_source", STRING),
    col("last_order_history_id", STRING),
    col("raw_data", STRING),
])

ORDER_HISTORY = StructType([
    key("id", STRING),
    key("account_id", STRING),
    col("account_product_code", STRING),
    key("account_type", STRING),
    key("market_type", STRING),
    col("start_date", DATE),
    col("end_date", DATE),
    key("fetched_at", TIME),
    col("data", STRING),
])

TRADE_PROFIT_HISTORY = StructType([
    key("id", STRING),
    key("account_id", STRING),
    key("market_type", STRING),
    col("start_date", DATE),
    col("end_date", DATE),
    key("fetched_at", TIME),
    col("data", STRING),
])

TABLES: dict[str, StructType] = {
    "price_history": PRICE_HISTORY,
    "exchange_rate_history": EXCHANGE_RATE_HISTORY,
    "portfolio_snapshots": PORTFOLIO_SNAPSHOTS,
    "overseas_asset_snapshots": OVERSEAS_ASSET_SNAPSHOTS,
    "asset_overview_snapshots": ASSET_OVERVIEW_SNAPSHOTS,
    "asset_holding_snapshots": ASSET_HOLDING_SNAPSHOTS,
    "market_calendar": MARKET_CALENDAR,
    "instrument_master": INSTRUMENT_MASTER,
    "instrument_classification_overrides": CLASSIFICATION_OVERRIDES,
    "domestic_orders": DOMESTIC_ORDERS,
    "order_history": ORDER_HISTORY,
    "trade_profit_history": TRADE_PROFIT_HISTORY,
}

KEYS: dict[str, tuple[str, ...]] = {
    "price_history": ("symbol", "exchange", "date"),
    "exchange_rate_history": ("currency", "date", "period"),
    "domestic_orders": ("account_id", "account_product_code", "order_date", "order_branch_no", "order_no"),
    "market_calendar": ("market", "trade_date"),
    "instrument_master": ("symbol", "market"),
    "instrument_classification_overrides": ("symbol", "market"),
}

# The column each table is split by on disk: its month (see `tables.part_of`).
TIME_COLUMN: dict[str, str] = {
    "price_history": "date",
    "exchange_rate_history": "date",
    "portfolio_snapshots": "snapshot_at",
    "overseas_asset_snapshots": "snapshot_at",
    "asset_overview_snapshots": "snapshot_at",
    "asset_holding_snapshots": "snapshot_at",
    "domestic_orders": "order_date",
    "order_history": "fetched_at",
    "trade_profit_history": "fetched_at",
}
# The others, by year of the day or by market.
SPLIT_COLUMN: dict[str, str] = {
    "market_calendar": "trade_date",
    "instrument_master": "market",
    "instrument_classification_overrides": "market",
}
