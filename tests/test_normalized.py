"""Realised profits, fills and market sessions against plain versions."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from folioframe.operators.sequence import with_previous
from folioframe.plans import fills, profits, sessions
from folioframe.streaming import jobs

REPORTS = "id string, account_id string, market_type string, start_date date, end_date date, fetched_at timestamp_ntz, data string"
D = dt.date


def trade(day, symbol, profit, **more):
    return {"trad_dt": day and day.strftime("%Y%m%d"), "pdno": symbol, "prdt_name": f"name {symbol}", "rlzt_pfls": str(profit), **more}


def report(number, start, end, fetched, *trades, account="a"):
    return (number, account, "domestic", start, end, dt.datetime(2024, 1, 1) + dt.timedelta(hours=fetched), json.dumps({"output1": list(trades)}))


def told(spark, rows):
    frame = spark.createDataFrame(rows, REPORTS)
    return {(r.account_id, r.trade_date, r.symbol): (r.report_id, r.profit_amt, r.lots) for r in profits.trade_profits(frame).collect()}


def test_the_latest_report_of_a_day_speaks_for_it(spark):
    day = D(2024, 3, 10)
    rows = [
        report("year", D(2024, 1, 1), D(2024, 12, 31), 1, trade(day, "A", 1), trade(day, "B", 2), trade(D(2024, 4, 1), "A", 3), trade(D(2024, 3, 31), "C", 4)),
        # Nested: B was taken back, A corrected.
        report("month", D(2024, 3, 1), D(2024, 3, 31), 2, trade(day, "A", 10)),
        # Touching the one before, and fetched before the year's.
        report("april", D(2024, 4, 1), D(2024, 4, 2), 0, trade(D(2024, 4, 1), "A", 99)),
        # Overlapping both ends of a month, without any trade.
        report("empty", D(2024, 6, 20), D(2024, 8, 3), 5),
        report("summer", D(2024, 6, 1), D(2024, 8, 31), 4, *[trade(D(2024, m, d), "S", m) for m, d in ((6, 19), (6, 20), (7, 15), (8, 3), (8, 4))]),
        report("other", D(2024, 3, 10), D(2024, 3, 10), 0, trade(day, "A", 7), trade(day, "A", 8, sll_qty="1,000"), account="b"),
    ]
    assert told(spark, rows) == {
        ("a", day, "A"): ("month", 10.0, 1), ("a", D(2024, 4, 1), "A"): ("year", 3.0, 1),
        ("a", D(2024, 6, 19), "S"): ("summer", 6.0, 1), ("a", D(2024, 8, 4), "S"): ("summer", 8.0, 1),
        ("b", day, "A"): ("other", 15.0, 2)}


def test_reports_that_cannot_be_read_and_rows_that_cannot_count(spark):
    day = D(2024, 3, 10)
    rows = [report("1", day, day, 1, trade(day, "A", 1), trade(None, "A", 2), trade(day, None, 3), trade(day, " ", 4), trade(D(2024, 3, 11), "A", 5)),
            ("2", "a", "domestic", day, day, None, "<html>"), ("3", "a", "domestic", day, D(2024, 3, 1), dt.datetime(2025, 1, 1), '{"output1":[]}'),
            ("4", "c", "domestic", None, day, dt.datetime(2025, 1, 1), json.dumps({"output1": [trade(day, "A", 1)]})),
            ("5", "d", "overseas", day, day, dt.datetime(2025, 1, 1), json.dumps({"output1": [
                {"trad_day": "2024-03-10", "ovrs_pdno": "AAPL", "ovrs_item_name": "Apple", "slcl_qty": "2", "ovrs_rlzt_pfls_amt": "3.5"}, "odd"]}))]
    frame = spark.createDataFrame(rows, REPORTS)
    made = {(r.account_id, r.symbol): (r.profit_amt, r.sell_qty, r.symbol_name) for r in profits.trade_profits(frame).collect()}
    assert made == {("a", "A"): (1.0, None, "name A"), ("d", "AAPL"): (3.5, 2.0, "Apple")}
    assert sorted(str(r.id) for r in profits.report_rows(frame).rejects.collect()) == ["1", "1", "1", "1", "4"]
    assert profits.trade_profits(frame.filter(F.lit(False))).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_overlapping_ranges_against_plain(spark, seed):
    rng = random.Random(seed)
    base = D(2023, 12, 1)
    rows, plain = [], []
    for k in range(60):
        start = base + dt.timedelta(rng.randrange(150))
        end = start + dt.timedelta(rng.choice([0, 1, 6, 29, 30, 31, 89, 200]))
        days = {start, end, start + dt.timedelta(rng.randrange((end - start).days + 1))}
        account, fetched = rng.choice(["a", "a", "b"]), rng.randrange(25)
        rows.append(report(f"r{k:02}", start, end, fetched, *[trade(d, s, k) for d in days for s in ("A", "B") if rng.random() < 0.7], account=account))
        plain.append((account, start, end, fetched, f"r{k:02}", json.loads(rows[-1][-1])["output1"]))
    want = {}
    for account, *_, number, trades in plain:
        for t in trades:
            day = dt.datetime.strptime(t["trad_dt"], "%Y%m%d").date()
            covering = [(f, n) for a, s, e, f, n, _ in plain if a == account and s <= day <= e]
            if max(covering)[1] == number:
                want[account, day, t["pdno"]] = (number, float(t["rlzt_pfls"]), 1)
    assert told(spark, rows) == want


def test_a_range_of_ten_years_is_few_pieces(spark):
    frame = spark.createDataFrame([report("1", D(2014, 2, 2), D(2024, 2, 27), 1), report("2", D(2024, 2, 1), D(2024, 2, 29), 1),
                                   report("3", D(2024, 2, 2), D(2024, 2, 28), 1)], REPORTS)
    counts = {(r.id, r.whole): r["count"] for r in profits.covers(frame).groupBy("id", "whole").count().collect()}
    assert counts == {("1", True): 119, ("1", False): 27 + 27, ("2", True): 1, ("3", False): 27}


SEQUENCE = "k string, t int, v int"


@pytest.mark.parametrize("tasks", [None, 1, 7, 40])
def test_previous_rows_against_plain(spark, tasks):
    rng = random.Random(7)
    rows = [(k, t, rng.choice([None, 1, 2])) for k in ("hot", "a", None, "b") for t in rng.sample(range(2000), 900 if k == "hot" else 12)]
    got = with_previous(spark.createDataFrame(rows, SEQUENCE), ["k"], ["t"], ["v", "t"], tasks=tasks)
    want, last = [], {}
    for k, t, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        want.append((k, t, v, *last.get(k, (None, None))))
        last[k] = (v, t)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert got.columns == ["k", "t", "v", "previous_v", "previous_t"]


def test_a_hot_sequence_is_cut_over_tasks(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    got = with_previous(rows, ["k"], ["t"], ["t"], tasks=8)
    assert got.filter("previous_t IS NULL").count() == 1 and got.filter("t - previous_t != 1").count() == 0
    assert got.groupBy(F.lit(1)).agg(F.count(F.lit(1)).alias("n")).first()["n"] == 20_000


SEEN = ("account_id string, account_product_code string, order_date date, order_branch_no string, order_no string, "
        "seen_at timestamp_ntz, place int, filled_qty long, filled_amount long, is_cancelled boolean")


def seen(minute, qty, amount=None, cancelled=False, number="A", place=0):
    return ("1", "01", D(2024, 1, 2), "", number, dt.datetime(2024, 1, 2, 9, minute), place, qty, amount, cancelled)


def events(frame):
    return sorted((r.order_no, r.seen_at.minute, r.kind, r.filled_qty, r.filled_amount, r.cancelled, r.price,
                   r.previous_seen_at and r.previous_seen_at.minute) for r in fills.fills(frame).collect())


def test_fills_corrections_and_cancels(spark):
    rows = [seen(1, 0), seen(2, 4, 400), seen(3, 4, 400), seen(5, 10, 1060), seen(6, 8, 850), seen(7, 8, 840), seen(8, 8, 840, True), seen(9, 8, 840, True),
            seen(2, 4, 400), seen(1, None, number="N"), seen(1, 3, None, True, number="B")]
    assert events(fills.sightings(spark.createDataFrame(rows, SEEN))) == [
        ("A", 2, "fill", 4, 400, False, 100.0, 1), ("A", 5, "fill", 6, 660, False, 110.0, 3), ("A", 6, "correction", -2, -210, False, None, 5),
        ("A", 7, "correction", 0, -10, False, None, 6), ("A", 8, "cancel", 0, 0, True, None, 7), ("B", 1, "fill", 3, 0, True, None, None)]


def test_a_late_sighting_splits_a_fill(spark):
    early = [seen(1, 2, 200), seen(9, 10, 1000)]
    late = [seen(5, 6, 620)]
    first = fills.sightings(spark.createDataFrame(early, SEEN))
    whole = fills.sightings(first.unionByName(fills.sightings(spark.createDataFrame(late, SEEN))))
    assert [e[1:5] for e in events(first)] == [(1, "fill", 2, 200), (9, "fill", 8, 800)]
    assert [e[1:5] for e in events(whole)] == [(1, "fill", 2, 200), (5, "fill", 4, 420), (9, "fill", 4, 380)]


def test_streamed_fills_do_not_hang_on_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [seen(rng.randrange(60), rng.randrange(20), rng.randrange(900), rng.random() < 0.1, rng.choice("AB"), place) for place in range(120)]
    want = events(fills.sightings(spark.createDataFrame(rows, SEEN)))
    for files in (1, 4):
        folder, rest = str(tmp_path / f"in{files}"), rows[:]
        rng.shuffle(rest)
        for part in range(6):
            spark.createDataFrame(rest[part * 20:part * 20 + 20] + rest[:3], SEEN).coalesce(1).write.mode("append").parquet(folder)
        out = str(tmp_path / f"out{files}")
        stream = jobs.read_files(spark, folder, spark.createDataFrame([], SEEN).schema, files_per_batch=files)
        jobs.write_partials(stream, fills.sightings, out, str(tmp_path / f"state{files}")).awaitTermination()
        assert events(jobs.read_partials(spark, out, fills.sightings)) == want
        jobs.compact_partials(spark, out, fills.sightings)
        assert events(jobs.read_partials(spark, out, fills.sightings)) == want


CALENDAR = "market string, trade_date date, is_open boolean, open_time_local string, close_time_local string, timezone string"


def some_sessions(spark):
    return sessions.market_sessions(spark.createDataFrame([
        ("krx", D(2024, 3, 11), True, "09:00", "15:30", "Asia/Seoul"), ("krx", D(2024, 3, 12), False, None, None, "Asia/Seoul"),
        # The clock changes on the 10th of March.
        ("nyse", D(2024, 3, 8), True, "09:30", "16:00", "America/New_York"), ("nyse", D(2024, 3, 11), True, "09:30", "13:00", "America/New_York"),
        ("night", D(2024, 3, 8), True, "18:00", "05:00", "America/Chicago"), ("odd", D(2024, 3, 8), True, "09:00", "10:00", None)], CALENDAR))


def test_sessions_in_universal_time(spark):
    got = {(r.market, r.trade_date.day): (r.open_at, r.close_at, r.minutes) for r in some_sessions(spark).collect()}
    at = lambda d, h, m=0: dt.datetime(2024, 3, d, h, m)
    assert got == {("krx", 11): (at(11, 0), at(11, 6, 30), 390), ("nyse", 8): (at(8, 14, 30), at(8, 21), 390),
                   ("nyse", 11): (at(11, 13, 30), at(11, 17), 210), ("night", 8): (at(9, 0), at(9, 11), 660)}


def test_events_are_tagged_at_their_bounds(spark):
    at = lambda d, h, m=0, s=0: dt.datetime(2024, 3, d, h, m, s)
    rows = [(1, "krx", at(11, 0)), (2, "krx", at(11, 6, 29, 30)), (3, "krx", at(11, 6, 30)), (4, "krx", at(10, 23, 59)), (5, "nyse", at(11, 13, 29)),
            (6, "nyse", at(11, 13, 30)), (7, "nyse", at(11, 18)), (8, "night", at(9, 10, 59)), (9, "none", at(11, 1)), (10, None, at(11, 1)), (11, "krx", None)]
    events_ = spark.createDataFrame(rows, "n int, market string, at timestamp_ntz")
    made = sessions.tag_sessions(events_, some_sessions(spark))
    got = {r.n: (r.session_date and r.session_date.day, r.minutes_from_open, r.minutes_to_close) for r in made.collect()}
    none = (None, None, None)
    assert got == {1: (11, 0, 390), 2: (11, 389, 0), 3: none, 4: none, 5: none, 6: (11, 0, 210), 7: none, 8: (8, 659, 1), 9: none, 10: none, 11: none}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
