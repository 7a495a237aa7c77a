"""Every registered query against its SQL, and what its plan must not hold."""

import pytest

import check
from folioframe.registry import ORACLES, QUERIES
from folioframe.registry.core import UNITS

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows_as_sql(spark, name):
    outcome, _seconds, good = check.compare(spark, name, FOLDER)
    assert good, outcome


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_every_unit_of_the_inventory_is_covered():
    sizes = {"A": 13, "B": 15, "C": 14, "D": 8, "E": 10, "F": 6, "G": 17, "H": 5, "I": 2, "J": 18, "K": 4}
    wanted = {f"{letter}{n}" for letter, count in sizes.items() for n in range(1, count + 1)}
    assert wanted - {unit for units in UNITS.values() for unit in units.split()} == set()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "total_asset_overview", "overview_holdings", "order_history_rows", "price_coverage", "latest_raw_observation",
    "insert_absent_prices", "portfolio_anomalies_all_accounts", "collection_gate", "overseas_top_holdings",
])
def test_no_pairs_are_tried(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_lookback_reaches_the_scan(spark):
    text = plan(QUERIES["latest_portfolio_summary"](spark, FOLDER))
    assert "GreaterThanOrEqual(ts,2024-01-26T00:00)" in text and "props" not in text.split("ReadSchema")[1]


def test_anomalies_need_no_join_and_one_shuffle_by_account(spark):
    text = plan(QUERIES["portfolio_anomalies_all_accounts"](spark, FOLDER))
    assert "Join" not in text and text.count("hashpartitioning(account_id") == 2


def test_top_lists_are_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["top_parts_with_other"](spark, FOLDER))
