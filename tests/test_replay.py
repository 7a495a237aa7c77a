"""Observations whose orders never reached the stored ones."""

import datetime as dt

from pyspark.sql import types as T

from folioframe.operators.tables import conform
from folioframe.plans import orders
from folioframe.schemas import DOMESTIC_ORDERS, ORDER_HISTORY

FULL, EMPTY = '{"output1":[{"odno":"1"}]}', '{"output1":[]}'


def day(number):
    return dt.date(2024, 1, number)


def tables(spark):
    at = dt.datetime(2024, 2, 1)
    history = [
        ("a", "1", "01", "domestic", day(1), day(3), at, FULL),       # An order is stored on the last day.
        ("b", "1", "01", "domestic", day(4), day(6), at, FULL),       # Lost.
        ("c", "1", "01", "domestic", day(7), day(9), at, EMPTY),      # Lists nothing.
        ("d", "1", None, "domestic", day(10), day(11), at, FULL),     # Serves a request of product 01, stored orders too.
        ("e", "2", "01", "domestic", day(1), day(3), at, FULL),       # Another account: lost.
        ("f", "3", "01", "domestic", day(5), day(4), at, FULL),       # A range without days.
        ("g", "4", "01", "domestic", day(1), day(2), at, FULL),       # Stored twice under one id, once without a list.
        ("g", "4", "01", "domestic", day(1), day(2), at, "text"),
    ]
    names = ("id", "account_id", "account_product_code", "market_type", "start_date", "end_date", "fetched_at", "data")
    kinds = {f.name: f.dataType for f in ORDER_HISTORY.fields}
    observed = conform(spark.createDataFrame(history, T.StructType([T.StructField(n, kinds[n]) for n in names])), ORDER_HISTORY)
    asked = spark.createDataFrame(
        sorted({(h[1], "01", *h[3:6]) for h in history}),
        "account_id string, account_product_code string, market_type string, start_date date, end_date date")
    stored = conform(spark.createDataFrame(
        [("1", "01", day(3), "x"), ("1", "01", day(11), "y")],
        "account_id string, account_product_code string, order_date date, order_no string"), DOMESTIC_ORDERS)
    return asked, observed, stored


def test_lost_observations(spark):
    found = orders.missing_from_canonical(*tables(spark))
    assert sorted((r["id"], r["data"]) for r in found.collect()) == [("b", FULL), ("e", FULL), ("f", FULL), ("g", FULL)]


def test_payloads_are_fetched_and_read_once(spark):
    plan = orders.missing_from_canonical(*tables(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
