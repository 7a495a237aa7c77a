"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data (default the largest test scale), BENCH_CPUS the local cores. Each query is run to
the end with its rows discarded, after one small query to start the JVM's work.
"""

from __future__ import annotations

import json
import os
import time

from folioframe.registry import QUERIES
from folioframe.session import build_session

HEADLINE = (
    "portfolio_daily_change", "portfolio_daily_snapshots", "asset_overview_daily_snapshots",
    "bollinger_bands_all_symbols", "latest_portfolio_summary", "portfolio_anomalies_all_accounts",
    "portfolio_trend_all_accounts", "total_asset_history", "total_asset_daily_change", "total_asset_trend",
    "total_asset_allocation_history", "overseas_valuation_totals", "overseas_top_holdings", "classified_holdings",
    "total_asset_overview", "overview_holdings", "domestic_holding_rows", "canonical_order_rows", "upsert_orders",
    "insert_absent_prices", "overwrite_adjusted_prices", "upsert_master", "collection_gate",
    "order_collection_outcomes", "order_history_rows", "latest_raw_observation", "trading_calendar",
    "price_coverage", "stream_order_upsert", "stream_daily_last_value", "stream_duplicate_drop", "stored_order_merge",
    "stored_calendar_merge", "stored_master_merge", "replayed_orders", "parquet_reload",
    "gate_with_incomplete_calendar", "fx_daily", "account_nav_daily", "trade_profit_normalized", "order_fills",
    "events_by_market_session",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", spark__master=f"local[{cpus}]", spark__ui__enabled="false", spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["daily_totals"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
