"""Seeded series with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioframe.functions import limits
from folioframe.operators import curate, reads
from folioframe.plans import assets, portfolio, prices

AS_OF = "20240301"
DAY1 = dt.date(2024, 1, 1)


def day(n):
    return DAY1 + dt.timedelta(days=n - 1)


def at(n, hour=0):
    return dt.datetime.combine(day(n), dt.time(hour))


def price_rows(spark, count):
    rows = [("005930", "KRX", day(d), 100.0 + d, 110.0 + d, 90.0 + d, 100.0 + d, 1000 + d) for d in range(1, count + 1)]
    return spark.createDataFrame(rows, "symbol STRING, exchange STRING, date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume LONG")


SNAP = "id STRING, account_id STRING, account_type STRING, snapshot_at TIMESTAMP_NTZ, total_eval_amt LONG, balance_data STRING"


def snapshots(spark, count, *accounts):
    rows = [(f"{account}-{d}", account, kind, at(d), 1_000_000 + d * 10_000, '{"ok": true}')
            for account, kind in accounts for d in range(1, count + 1)]
    return spark.createDataFrame(rows, SNAP)


def test_bands_latest_rows(spark):
    rows = prices.bollinger_bands(price_rows(spark, 30), "005930", window=20, limit=3).collect()
    assert len(rows) == 3
    assert rows[0].date == dt.date(2024, 1, 30)
    assert rows[0].signal == "중립"


def test_bands_need_a_full_window(spark):
    assert prices.bollinger_bands(price_rows(spark, 5), "005930", window=20).count() == 0
    assert prices.price_counts(price_rows(spark, 5)).first().rows == 5


def test_bands_one_symbol_equals_all(spark):
    history = price_rows(spark, 30)
    other = history.withColumn("symbol", F.lit("000660")).withColumn("close", F.col("close") * 2)
    every = prices.bollinger_bands(history.unionByName(other), window=10, limit=5)
    one = prices.bollinger_bands(history, "005930", window=10, limit=5)
    assert sorted(every.filter("symbol = '005930'").collect()) == sorted(one.collect())


def test_flat_prices_have_no_z_score(spark):
    flat = price_rows(spark, 10).withColumn("close", F.lit(5.0))
    row = prices.bollinger_bands(flat, "005930", window=5, limit=1).first()
    assert row.z_score is None and row.signal == "중립" and row.upper_band == 5.0


def test_trend(spark):
    daily = curate.portfolio_daily(snapshots(spark, 40, ("acct", "brokerage")))
    rows = portfolio.trend(daily, "acct", 7, 30, 3650, AS_OF).collect()
    assert len(rows) == 11
    assert rows[0].snap_date == dt.date(2024, 2, 9)
    assert rows[0].trend == "상승추세"


def test_anomalies_ranked(spark):
    daily = curate.portfolio_daily(snapshots(spark, 40, ("acct", "brokerage")))
    rows = portfolio.anomalies(daily, "acct", 2.0, 3650, 5, AS_OF).collect()
    assert len(rows) == 5
    assert [abs(r.z_score) for r in rows] == sorted((abs(r.z_score) for r in rows), reverse=True)


def test_anomaly_lookback_is_cut_before_the_previous_day(spark):
    daily = curate.portfolio_daily(snapshots(spark, 40, ("acct", "brokerage")))
    rows = portfolio.anomalies(daily, "acct", lookback_days=10, limit=None, as_of=day(40)).collect()
    assert min(r.snap_date for r in rows) == day(31)


def test_unknown_z_sorts_last_as_normal(spark):
    rows = [("a", "t", at(d), v) for d, v in ((1, 0), (2, 100), (3, 110), (4, 130))]
    daily = spark.createDataFrame(rows, "account_id STRING, account_type STRING, snapshot_at TIMESTAMP_NTZ, total_eval_amt LONG")
    daily = daily.withColumn("snap_date", F.col("snapshot_at").cast("date"))
    out = portfolio.anomalies(daily, "a", lookback_days=90, limit=20, as_of=AS_OF).collect()
    assert out[-1].z_score is None and out[-1].status == "정상" and out[-1].snap_date == day(2)


def test_latest_summary(spark):
    snaps = snapshots(spark, 3, ("acct-a", "brokerage"), ("acct-b", "isa"))
    summary = portfolio.latest_summary(curate.portfolio_daily(snaps), lookback_days=3650, as_of=AS_OF)
    totals = {r.account_type: r for r in portfolio.totals_by_type(summary).collect()}
    assert set(totals) == {"brokerage", "isa", "ALL"}
    assert totals["ALL"].account_count == 2 and totals["ALL"].total_eval_amt == 2_060_000
    direct = portfolio.latest_summary_of_snapshots(snaps, lookback_days=3650, as_of=AS_OF)
    assert direct.collect() == summary.collect()


def test_daily_change(spark):
    snaps = snapshots(spark, 3, ("acct-a", "brokerage"), ("acct-b", "brokerage"))
    rows = portfolio.daily_change(curate.portfolio_daily(snaps), days=3).collect()
    assert len(rows) == 3
    assert (rows[0].total_eval_amt, rows[0].prev_total_eval_amt, rows[0].change_amt) == (2_060_000, 2_040_000, 20_000)


def test_daily_change_looks_before_the_rows_it_returns(spark):
    daily = curate.portfolio_daily(snapshots(spark, 10, ("acct", "brokerage")))
    rows = portfolio.daily_change(daily, days=2).collect()
    assert [r.change_amt for r in rows] == [10_000, 10_000]


def test_last_of_day_skips_unvalued_and_breaks_ties_by_id(spark):
    rows = [
        ("1", "a", "t", at(1, 9), 10, None), ("2", "a", "t", at(1, 15), 20, "{}"), ("3", "a", "t", at(1, 15), 30, None),
        ("4", "a", "t", at(1, 18), None, '{"late": 1}'), ("5", "a", "t", at(2, 9), None, "{}"),
    ]
    out = curate.portfolio_daily(spark.createDataFrame(rows, SNAP)).collect()
    assert [(r.snap_date, r.total_eval_amt, r.balance_data) for r in out] == [(day(1), 30, "{}")]
    assert out[0].snapshot_at == at(1, 15)


def overviews(spark, count=40):
    rows = [(str(d), at(d), 600_000 + 5000 * d, 300_000 + 3000 * d, 100_000 + 2000 * d, 400_000 + 5000 * d,
             1_000_000 + 10_000 * d, 60.0, 40.0, 30.0, 10.0, 500_000, 300_000, 100_000, 100_000, 0) for d in range(1, count + 1)]
    return spark.createDataFrame(rows, """id STRING, snapshot_at TIMESTAMP_NTZ, domestic_eval_amt_krw LONG, overseas_stock_eval_amt_krw LONG,
        overseas_cash_amt_krw LONG, overseas_total_asset_amt_krw LONG, total_eval_amt_krw LONG, domestic_pct DOUBLE, overseas_pct DOUBLE,
        overseas_stock_pct DOUBLE, overseas_cash_pct DOUBLE, domestic_direct_amt_krw LONG, overseas_direct_amt_krw LONG,
        overseas_indirect_amt_krw LONG, cash_amt_krw LONG, unknown_amt_krw LONG""")


def test_total_asset_analytics(spark):
    daily = curate.overview_daily(overviews(spark))
    history = assets.history(daily, 3650, 5, AS_OF).collect()
    assert len(history) == 5 and history[0].total_eval_amt_krw == 1_400_000
    trend = assets.trend(daily, 7, 30, 3650, AS_OF).collect()
    assert len(trend) == 11 and trend[0].trend == "상승추세"
    three = curate.overview_daily(overviews(spark, 3))
    assert assets.daily_change(three, 3).first().change_amt == 10_000
    allocation = assets.allocation_history(three, 3650, AS_OF).collect()
    assert len(allocation) == 3 and allocation[0].overseas_indirect_amt_krw == 100_000


def test_overview_columns_of_a_day_may_come_from_different_rows(spark):
    rows = overviews(spark, 1)
    later = rows.withColumns({"id": F.lit("9"), "snapshot_at": F.lit(at(1, 12)), "domestic_pct": F.lit(None).cast("double"),
                              "total_eval_amt_krw": F.lit(5).cast("bigint")})
    row = curate.overview_daily(rows.unionByName(later)).first()
    assert (row.id, row.total_eval_amt_krw, row.domestic_pct) == ("9", 5, 60.0)


def test_snapshot_range_keeps_the_last_instant_of_the_end_day(spark):
    last = dt.datetime(2024, 1, 2, 23, 59, 59, 900_000)
    rows = [("1", "a", "t", at(1), 1, None), ("2", "a", "t", last, 2, None), ("3", "a", "t", at(3), 3, None)]
    out = reads.portfolio_snapshots(spark.createDataFrame(rows, SNAP), "a", "20240101", "2024-01-02").collect()
    assert [r.id for r in out] == ["2", "1"]


@pytest.mark.parametrize("asked", [1, 5, 99_999])
def test_lookback_is_as_long_as_asked(spark, asked):
    first = reads.as_day(AS_OF) - dt.timedelta(days=asked)
    assert spark.range(1).select(reads.since(AS_OF, limits.lookback(asked)).alias("d")).first().d == first


def test_bad_parameters_raise():
    for bad in (lambda: limits.lookback(0), lambda: limits.band_window(1), lambda: limits.row_limit(0),
                lambda: limits.at_least(0.01), lambda: limits.trend_windows(1, 3, 9),
                lambda: limits.trend_windows(5, 3, 9), lambda: limits.trend_windows(3, 5, 4),
                lambda: limits.top_n(0), lambda: limits.lookback(2.5)):
        with pytest.raises(ValueError):
            bad()
    assert limits.row_limit(None) is None and limits.row_limit(10_000) == 10_000 and limits.top_n(5000) == 5000
    assert limits.trend_windows(1000, 5000, 9000) == (1000, 5000, 9000)


def test_nothing_is_cut_unasked(spark):
    days = 4200
    history = price_rows(spark, days)
    assert prices.bollinger_bands(history, window=10).count() == days - 9
    assert prices.bollinger_bands(history, "005930", window=10).count() == days - 9
    assert prices.bollinger_bands(history, "005930", window=400, limit=3000).count() == 3000
    daily = spark.range(days).select(
        F.lit("a").alias("account_id"), F.lit("t").alias("account_type"),
        F.expr("date_sub(DATE '2024-01-31', CAST(id AS INT))").alias("snap_date"),
        (F.col("id") % 7 + 100).alias("total_eval_amt")).withColumn("snapshot_at", F.col("snap_date").cast("timestamp_ntz"))
    assert reads.lookback(daily, "20240131", 5000).count() == days
    assert portfolio.anomalies(daily, lookback_days=5000, as_of="20240131").count() == days - 1
    assert portfolio.daily_change(daily, days=4000).count() == 4000
    assert portfolio.trend(daily, short_window=300, long_window=400, lookback_days=5000, as_of="20240131").count() == days - 399
    assert reads.portfolio_snapshots(daily.withColumn("id", F.lit("x")), "a").count() == days
