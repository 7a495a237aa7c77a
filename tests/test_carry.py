"""Values carried forward, daily exchange rates, daily account values and the calendar that repairs itself."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folioframe.operators import tables
from folioframe.operators.carry import carry_forward, day_spine
from folioframe.plans import gate, moments, portfolio, rates
from folioframe.sources import dimensions

DAY = dt.date(2024, 1, 31)


def now():
    return F.lit("2026-04-24 00:00:00").cast("timestamp_ntz")


def plain_carry(rows):
    """Rows of (key, day, a, b), one a key and day."""
    out, last = [], {}
    for key, day, a, b in sorted(rows, key=lambda r: (str(r[0]), r[1] or dt.date.min)):
        if day is None:
            out.append((key, day, a, b))
            continue
        if a is not None or b is not None:
            last[key] = (a, b)
        out.append((key, day, *last.get(key, (None, None))))
    return sorted(out, key=str)


SCHEMA = "k string, d date, a int, b string"


def carried(spark, rows):
    return sorted(map(tuple, carry_forward(spark.createDataFrame(rows, SCHEMA), ["k"], "d", ["a", "b"]).collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_carry_against_plain(spark, seed):
    rng = random.Random(seed)
    rows = []
    for key in ("x", "y", None, "hot"):
        for back in sorted(rng.sample(range(900), 700 if key == "hot" else 40)):
            known = rng.random() < 0.1
            rows.append((key, DAY - dt.timedelta(back), rng.randrange(9) if known else None,
                         "b" if known and rng.random() < 0.5 else None))
    rows += [("x", None, None, None), ("z", None, 4, None)]
    assert carried(spark, rows) == plain_carry(rows)


def test_values_of_one_row_travel_together_over_empty_months(spark):
    rows = [("x", dt.date(2023, 1, 5), 1, "one"), ("x", dt.date(2023, 1, 31), 2, None), ("x", dt.date(2023, 9, 1), None, None),
            ("x", dt.date(2022, 1, 1), None, None)]
    assert carried(spark, rows) == plain_carry(rows)
    assert ("x", dt.date(2023, 9, 1), 2, None) in carried(spark, rows)


def test_carry_keeps_columns_and_empty_tables(spark):
    rows = spark.createDataFrame([("x", DAY, None, "b", 1), ("x", DAY + dt.timedelta(40), None, None, 2)], SCHEMA + ", extra int")
    made = carry_forward(rows, ["k"], "d", ["a", "b"])
    assert made.columns == rows.columns and sorted((r.b, r.extra) for r in made.collect()) == [("b", 1), ("b", 2)]
    assert carry_forward(rows.filter(F.lit(False)), ["k"], "d", ["a"]).collect() == []


def test_no_window_of_a_whole_key(spark):
    """Days are windowed within months; the only window over a key holds its months."""
    rows = spark.range(4000).select(F.lit("k").alias("k"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("d"),
                                    F.when(F.col("id") % 97 == 0, F.col("id")).alias("a"))
    made = carry_forward(rows, ["k"], "d", ["a"])
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    # Either a window has the month among its keys, or its rows are an aggregate's.
    windows = [(i, line) for i, line in enumerate(plan.splitlines()) if "Window [" in line]
    assert len(windows) == 2
    for at, line in windows:
        keys = line.rsplit(", [", 2)[-2]
        assert "_block" in keys or any("Aggregate" in below for below in plan.splitlines()[at + 1:at + 4])
    assert made.filter(F.col("a") != F.floor(F.datediff("d", F.lit(DAY)) / 97) * 97).count() == 0


def test_spine_runs_to_the_last_day_of_all(spark):
    rows = spark.createDataFrame([("x", DAY), ("x", DAY + dt.timedelta(2)), ("y", DAY + dt.timedelta(5)), ("n", None)], "k string, d date")
    counts = {r.k: r["count"] for r in day_spine(rows, ["k"], "d").groupBy("k").count().collect()}
    assert counts == {"x": 6, "y": 1}
    assert day_spine(rows, ["k"], "d", until="2024-02-01").groupBy("k").count().collect()[0]["count"] == 2
    assert day_spine(rows.filter(F.lit(False)), ["k"], "d").collect() == []


RATES = "currency string, date date, period string, rate double, seq int"


def test_fx_daily(spark):
    day = lambda n: DAY + dt.timedelta(n)
    rows = spark.createDataFrame([
        ("usd", day(0), "D", 1300.0, 1), ("USD", day(0), "D", 1301.0, 2), ("USD", day(3), "D", 0.0, 3), ("USD", day(40), "D", 1310.0, 4),
        ("USD", day(2), "W", 9.0, 5), ("JPY", day(39), "D", 9.1, 6), ("JPY", day(40), "D", None, 7), (None, day(1), "D", 1.0, 8),
        ("EUR", None, "D", 1.0, 9)], RATES)
    made = rates.fx_daily(rows, order=["seq"])
    got = {(r.currency, r.date): (r.rate, r.rate_date, r.stale_days) for r in made.collect()}
    assert len(got) == made.count() == 41 + 2
    assert got["USD", day(39)] == (1301.0, day(0), 39) and got["USD", day(40)] == (1310.0, day(40), 0)
    assert got["JPY", day(40)] == (9.1, day(39), 1)
    assert rates.fx_daily(rows, order=["seq"], until=day(100)).filter("currency = 'USD'").count() == 101
    assert rates.fx_daily(rows.filter(F.lit(False))).collect() == []


DAILY = "account_id string, account_type string, snap_date date, total_eval_amt long"
HELD = "account_id string, snapshot_at timestamp_ntz, value_krw long"


def at(day, hour=9):
    return dt.datetime.combine(day, dt.time(hour))


def test_account_nav_takes_the_latest_snapshot_on_or_before_the_day(spark):
    day = lambda n: DAY + dt.timedelta(n)
    daily = spark.createDataFrame([("a", "isa", day(n), 100) for n in (0, 1, 45)] + [("a", "irp", day(1), 7), ("a", "isa", day(2), None),
                                  ("b", "isa", day(0), 50), ("c", "isa", day(0), 30)], DAILY)
    held = spark.createDataFrame([
        ("a", at(day(1), 9), 10), ("a", at(day(1), 15), 20), ("a", at(day(1), 15), 25), ("a", at(day(10)), 150), ("a", at(day(10)), None),
        ("b", at(day(-300)), 5), ("b", at(day(1)), 99), (None, at(day(0)), 1), ("c", None, 4), ("d", at(day(0)), 4)], HELD)
    got = {(r.account_id, r.snap_date): (r.total_eval_amt, r.holdings_amt, r.holding_count, r.cash_amt, r.holdings_at)
           for r in portfolio.account_nav(daily, held).collect()}
    assert got == {
        ("a", day(0)): (100, None, None, 100, None), ("a", day(1)): (107, 45, 2, 62, at(day(1), 15)),
        ("a", day(45)): (100, 150, 2, 0, at(day(10))), ("b", day(0)): (50, 5, 1, 45, at(day(-300))),
        ("c", day(0)): (30, None, None, 30, None)}


def test_account_nav_of_a_hot_account_against_plain(spark):
    rng = random.Random(5)
    values = {(a, DAY + dt.timedelta(n)): rng.randrange(1000) for a in "ab" for n in range(300) if a == "a" or n % 9 == 0}
    lines = [("a", at(DAY + dt.timedelta(rng.randrange(-50, 300)), rng.randrange(24)), rng.randrange(50)) for _ in range(3000)]
    daily = spark.createDataFrame([(a, "isa", d, v) for (a, d), v in values.items()], DAILY)
    got = {(r.account_id, r.snap_date): r.holdings_amt for r in portfolio.account_nav(daily, spark.createDataFrame(lines, HELD)).collect()}
    for (account, day), amount in got.items():
        times = [t for a, t, _ in lines if a == account and t.date() <= day]
        want = sum(v for a, t, v in lines if a == account and t == max(times)) if times else None
        assert amount == want
    assert got.keys() == values.keys()


def test_statistics_from_moments_equal_those_from_history(spark):
    rng = random.Random(6)
    rows = [(a, "isa", DAY + dt.timedelta(n), rng.randrange(100, 200)) for a, every in (("a", 1), ("b", 17), ("c", 90)) for n in range(0, 400, every)]
    rows += [("d", "isa", DAY + dt.timedelta(n), 100 * 2 ** (n // 30)) for n in range(0, 400, 30)] + [("e", "isa", DAY, 5), ("z", "isa", DAY, 0), ("z", "isa", DAY + dt.timedelta(399), 3)]
    daily, end = spark.createDataFrame(rows, DAILY), DAY + dt.timedelta(400)
    returns = moments.kept_returns(daily)
    kept = moments.kept_moments(returns)
    for days in (3, 31, 100, 250, 1000):
        told = portfolio.daily_returns(daily, days, end).groupBy("account_id").agg(
            F.count("_return").alias("n"), F.avg("_return").alias("mean"), F.stddev_samp("_return").alias("std")).filter("n > 0")
        want = {r.account_id: (r.n, r.mean, r.std) for r in told.collect()}
        got = {r.account_id: (r.n, r.mean, r["std"]) for r in moments.return_statistics(returns, kept, end, days).collect()}
        assert got.keys() == want.keys()
        for account, (n, mean, std) in want.items():
            assert got[account][0] == n and got[account][1] == pytest.approx(mean)
            assert got[account][2] == (None if std is None else pytest.approx(std, abs=1e-6))
    scored = moments.scored_returns(returns, kept, end, 250, 20)
    # Days 380 to 399, the first of which is the day that the lookback begins on.
    days = [r.snap_date for r in scored.filter("account_id = 'a'").orderBy("snap_date").collect()]
    assert days == [DAY + dt.timedelta(n) for n in range(380, 400)]
    assert moments.kept_moments(returns.filter(F.lit(False))).collect() == []


HOLIDAYS = [(dt.date(2026, 5, 5), "children"), (dt.date(2025, 3, 3), "other")]


def stored_calendar(spark, root, *years, last=None):
    days = dimensions.trading_calendar(spark.createDataFrame([(y,) for y in years], "year int"),
                                       spark.createDataFrame(HOLIDAYS, "date date, name string"))
    if last:
        days = days.filter(F.col("trade_date") <= F.lit(last))
    tables.append(days.withColumn("updated_at", F.lit("2020-01-01").cast("timestamp_ntz")), root, "market_calendar")


def asked(spark, *days, market="krx"):
    return spark.createDataFrame([(market, d, dt.datetime(2027, 1, 1)) for d in days], "market string, trade_date date, now timestamp_ntz")


def complete(spark, root, requests):
    holidays = spark.createDataFrame(HOLIDAYS, "date date, name string")
    return gate.complete_calendar(spark, root, gate.asked_years(requests), holidays, now())


def test_gaps_are_filled_once_and_whole_years_stay(spark, tmp_path):
    root = str(tmp_path)
    stored_calendar(spark, root, 2024)
    stored_calendar(spark, root, 2026, last=dt.date(2026, 4, 30))
    requests = asked(spark, dt.date(2024, 2, 1), dt.date(2025, 3, 3), dt.date(2026, 5, 5), dt.date(2026, 5, 6))
    assert complete(spark, root, requests) == (365 + 365, 0)
    calendar = tables.read_table(spark, root, "market_calendar")
    assert calendar.count() == calendar.select("market", "trade_date").distinct().count() == 366 + 365 + 365
    written = {r.y: r.n for r in calendar.filter(F.col("updated_at") == now()).groupBy(F.year("trade_date").alias("y")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    assert written == {2025: 365, 2026: 365}
    assert complete(spark, root, requests) == (0, 0)


def test_the_gate_opens_after_the_repair(spark, tmp_path):
    root = str(tmp_path)
    stored_calendar(spark, root, 2026, last=dt.date(2026, 4, 30))
    requests = asked(spark, dt.date(2026, 4, 23), dt.date(2026, 5, 1), dt.date(2026, 5, 6), dt.date(2025, 12, 31)).unionByName(
        asked(spark, dt.date(2026, 4, 23), market="nyse")).unionByName(asked(spark, None))
    before = gate.collection_gate(requests, tables.read_table(spark, root, "market_calendar"))
    assert before.filter("reason = 'calendar_missing'").count() == 5
    holidays = spark.createDataFrame(HOLIDAYS, "date date, name string")
    rows = gate.gate_stored(spark, root, requests, holidays, now()).collect()
    reasons = {(r.market, r.trade_date): r.reason for r in rows}
    assert reasons == {("krx", dt.date(2026, 4, 23)): "ready", ("krx", dt.date(2026, 5, 1)): "market_closed",
                       ("krx", dt.date(2026, 5, 6)): "ready", ("krx", dt.date(2025, 12, 31)): "market_closed",
                       ("nyse", dt.date(2026, 4, 23)): "calendar_missing", ("krx", None): "calendar_missing"}


def test_a_calendar_without_rows_is_filled_and_nothing_asked_writes_nothing(spark, tmp_path):
    root = str(tmp_path)
    tables.create(spark, root, "market_calendar")
    assert complete(spark, root, asked(spark, dt.date(2024, 1, 1)).filter(F.lit(False))) == (0, 0)
    assert complete(spark, root, asked(spark, dt.date(2024, 1, 1))) == (366, 0)
