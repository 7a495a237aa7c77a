"""Merges, stored tables, orders and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from folioframe import session
from folioframe.operators import curate, export, merge, reads, tables
from folioframe.plans import orders, portfolio
from folioframe.registry import QUERIES, streams
from folioframe.registry.standins import Tables
from folioframe.schemas import DOMESTIC_ORDERS, INSTRUMENT_MASTER, ORDER_HISTORY, PRICE_HISTORY, TABLES
from folioframe.sources import dimensions, masters
from folioframe.sources import orders as order_source
from folioframe.streaming import jobs


def now():
    return F.lit("2026-04-24 00:00:00").cast("timestamp_ntz")


PRICE_IN = "symbol STRING, exchange STRING, date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume LONG, seq INT"


def quote(day, close, seq, symbol="A"):
    return (symbol, "KRX", dt.date(2024, 1, day), close, close, close, close, 1, seq)


def closes(df):
    return {r.date.day: (r.close, r.adjusted) for r in df.collect()}


def test_prices_first_write_wins_then_adjusted_overwrites(spark):
    empty = spark.createDataFrame([], PRICE_HISTORY)
    first = merge.insert_prices(empty, spark.createDataFrame([quote(1, 10.0, 1), quote(1, 11.0, 2), quote(2, 20.0, 3)], PRICE_IN), now(), ["seq"])
    assert closes(first) == {1: (10.0, False), 2: (20.0, False)}
    again = merge.insert_prices(first, spark.createDataFrame([quote(1, 99.0, 1), quote(3, 30.0, 2)], PRICE_IN), now(), ["seq"])
    assert closes(again) == {3: (30.0, False)}
    adjusted = merge.overwrite_adjusted(first, spark.createDataFrame([quote(1, 5.0, 1), quote(1, 6.0, 2), quote(4, 40.0, 3)], PRICE_IN), now(), ["seq"])
    assert closes(adjusted) == {1: (6.0, True), 2: (20.0, False), 4: (40.0, True)}
    assert merge.insert_prices(adjusted, spark.createDataFrame([quote(1, 7.0, 1)], PRICE_IN), now(), ["seq"]).count() == 0


def test_rates_are_keyed_by_period_and_upper_currency(spark):
    schema = "currency STRING, date DATE, period STRING, rate DOUBLE, seq INT"
    day = dt.date(2024, 1, 1)
    stored = spark.createDataFrame([("USD", day, "D", 1.0, None)], "currency STRING, date DATE, period STRING, rate DOUBLE, created_at TIMESTAMP_NTZ")
    rows = spark.createDataFrame([("usd", day, "D", 2.0, 1), ("usd", day, "W", 3.0, 2), ("Usd", day, "W", 4.0, 3)], schema)
    assert [(r.currency, r.period, r.rate) for r in merge.insert_rates(stored, rows, now(), ["seq"]).collect()] == [("USD", "W", 3.0)]


def observation(number, filled, pending, seen, product="01", kind="brokerage"):
    day = dt.date(2026, 4, 23)
    return ("12345678", product, kind, day, "", number, "005930", filled, pending, "fetch" if seen == 1 else "batch", dt.datetime(2026, 4, 23, seen), 0)


SEEN = ("account_id STRING, account_product_code STRING, account_type STRING, order_date DATE, order_branch_no STRING, order_no STRING, "
        "symbol STRING, filled_qty LONG, pending_qty LONG, last_source STRING, seen_at TIMESTAMP_NTZ, place INT")


def test_order_seen_twice_is_one_row(spark):
    empty = spark.createDataFrame([], DOMESTIC_ORDERS)
    first = merge.upsert_orders(empty, spark.createDataFrame([observation("A-100", 2, 8, 1)], SEEN), F.lit(dt.datetime(2026, 4, 23, 1)).cast("timestamp_ntz"))
    rows = merge.upsert_orders(first, spark.createDataFrame([observation("A-100", 10, None, 2)], SEEN), now()).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row.filled_qty, row.pending_qty, row.last_source) == (10, None, "batch")
    assert row.first_seen_at == dt.datetime(2026, 4, 23, 1) and row.last_seen_at == dt.datetime(2026, 4, 24)


def test_same_number_of_two_products_stays_two_rows(spark):
    seen = [observation("A-100", 1, 1, 1), observation("A-100", 1, 1, 1, "29", "irp")]
    assert merge.upsert_orders(spark.createDataFrame([], DOMESTIC_ORDERS), spark.createDataFrame(seen, SEEN), now()).count() == 2


def test_a_key_with_a_third_of_the_rows_merges_to_its_last(spark):
    seen = spark.range(9000).select(
        F.lit("1").alias("account_id"), F.lit("01").alias("account_product_code"), F.lit("t").alias("account_type"),
        F.lit(dt.date(2024, 1, 1)).alias("order_date"), F.lit("").alias("order_branch_no"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("order_no"),
        F.col("id").alias("filled_qty"), F.lit(dt.datetime(2024, 1, 1)).alias("seen_at"), F.col("id").alias("place"))
    out = merge.upsert_orders(spark.createDataFrame([], DOMESTIC_ORDERS), seen, now())
    assert out.count() == 6001
    assert out.filter("order_no = 'hot'").first().filled_qty == 8997


MASTER_IN = "symbol STRING, market STRING, standard_code STRING, name STRING, group_code STRING, etp_code STRING, idx_large_code STRING, idx_mid_code STRING, idx_small_code STRING, seq INT"


def test_master_merge(spark):
    rows = [("A000001", "KRX", "STD1", "테스트ETF", "EF", "1", "001", "002", "003", 1), ("A000002", "", "STD2", "테스트리츠", "RT", "", "004", "005", "006", 2),
            ("", "KRX", "STD9", "none", "RT", "", "", "", "", 3)]
    first = merge.upsert_master(spark.createDataFrame([], INSTRUMENT_MASTER), masters.clean_master(spark.createDataFrame(rows, MASTER_IN)), now(), ["seq"])
    update = [("A000001", "KRX", "STD1B", "업데이트ETF", "FE", "9", "101", "102", "103", 1)]
    out = merge.upsert_master(first, masters.clean_master(spark.createDataFrame(update, MASTER_IN)), now(), ["seq"]).orderBy("symbol").collect()
    assert [(r.symbol, r.market, r.name, r.group_code, r.etp_code) for r in out] == [
        ("A000001", "KRX", "업데이트ETF", "FE", "9"), ("A000002", "KRX", "테스트리츠", "RT", None)]


def test_rewrite_touches_only_the_months_it_must(spark, tmp_path):
    root = str(tmp_path / "tables")
    rows = spark.createDataFrame([quote(1, 1.0, 1), ("A", "KRX", dt.date(2024, 2, 1), 2.0, 2.0, 2.0, 2.0, 1, 2)], PRICE_IN)
    assert tables.append(rows, root, "price_history") == 2
    before = {p.name for p in (tmp_path / "tables/price_history/month=2024-02").glob("*.parquet")}
    tables.rewrite(spark, root, "price_history", spark.createDataFrame([quote(1, 9.0, 1), quote(5, 5.0, 2)], PRICE_IN),
                   lambda target, new: merge.overwrite_adjusted(target, new, now(), ["seq"]))
    assert {p.name for p in (tmp_path / "tables/price_history/month=2024-02").glob("*.parquet")} == before
    out = {str(r.date): r.close for r in tables.read_table(spark, root, "price_history").collect()}
    assert out == {"2024-01-01": 9.0, "2024-01-05": 5.0, "2024-02-01": 2.0}


def test_rows_without_a_key_are_rejected_and_stored_ones_stay(spark, tmp_path):
    root = str(tmp_path / "tables")
    bad = ("A", "KRX", None, 7.0, 7.0, 7.0, 7.0, 1, 3)
    old = spark.createDataFrame([quote(1, 1.0, 1), bad], PRICE_IN)
    # As an older version of the writer may have left it.
    tables._laid_out(old, "price_history").write.partitionBy("month").parquet(f"{root}/price_history")
    with pytest.raises(Exception, match="NULL in the key"):
        tables.append(old, root, "price_history")
    again = spark.createDataFrame([quote(1, 2.0, 1), bad, bad], PRICE_IN)
    put = lambda: tables.insert(spark, root, "price_history", again, lambda target, new: merge.insert_prices(target, new, now(), ["seq"]))
    assert (put(), put()) == (0, 0)
    done = tables.rewrite(spark, root, "price_history", again, lambda target, new: merge.overwrite_adjusted(target, new, now(), ["seq"]))
    assert done == tables.Written(processed=1, rejected=2)
    assert sorted(map(str, [(r.date, r.close) for r in tables.read_table(spark, root, "price_history").collect()])) == [
        "(None, 7.0)", "(datetime.date(2024, 1, 1), 2.0)"]


@pytest.mark.parametrize("name", ["instrument_master", "market_calendar"])
def test_a_swap_that_failed_is_finished_by_the_retry(spark, tmp_path, monkeypatch, name):
    root = str(tmp_path / "tables")
    if name == "instrument_master":
        def rows(kind):
            return spark.createDataFrame([(s, m, f"{kind} {s}", 1) for s in "ab" for m in ("KRX", "NYS")], "symbol STRING, market STRING, name STRING, seq INT")
        put, value, update = merge.upsert_master, "name", rows("new").filter("market = 'KRX'")
    else:
        def rows(kind):
            return spark.createDataFrame([("krx", dt.date(y, 1, 2), kind == "new", "Asia/Seoul", "s", 1) for y in (2023, 2024)],
                                         "market STRING, trade_date DATE, is_open BOOLEAN, timezone STRING, source STRING, seq INT")
        put, value, update = merge.upsert_calendar, "is_open", rows("new").filter("trade_date >= '2024-01-01'")
    tables.append(rows("old").withColumn("updated_at", now()), root, name)
    before = sorted(map(str, tables.read_table(spark, root, name).select(value).collect()))
    def run():
        return tables.rewrite(spark, root, name, update, lambda target, new: put(target, new, now(), ["seq"]), batch=f"t-{name}-{tmp_path.name}")
    real = tables.swap
    def broken(spark_, root_, name_, merged):
        # The old parts are gone, and then the writer dies.
        for part in (tmp_path / "tables" / name).glob("part=*"):
            if part.name in ("part=p-KRX", "part=2024"):
                session.delete_path(spark_, str(part))
        raise RuntimeError("lost")
    monkeypatch.setattr(tables, "swap", broken)
    with pytest.raises(RuntimeError):
        run()
    monkeypatch.setattr(tables, "swap", real)
    assert run() == (update.count(), 0)
    after = sorted(map(str, tables.read_table(spark, root, name).select(value).collect()))
    assert len(after) == len(before) and after != before
    assert tables.read_table(spark, root, name).count() == rows("old").count()


def _orders_of(spark, account):
    """One order, and one that no table can hold."""
    row = observation("A-1", 5, 5, 1)
    return spark.createDataFrame([(account, *row[1:]), (account, *row[1:3], None, *row[4:])], SEEN)


def _put_orders(target, new):
    return merge.upsert_orders(target, new, now())


def test_a_stage_is_never_taken_for_another_table(spark, tmp_path, monkeypatch):
    """A table's rewrite fails before its swap; one of the same name and batch in another folder is not touched by it."""
    roots = [str(tmp_path / side / "tables") for side in ("a", "b")]
    for root in roots:
        tables.create(spark, root, "domestic_orders")
    real = tables.swap
    monkeypatch.setattr(tables, "swap", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        tables.rewrite(spark, roots[0], "domestic_orders", _orders_of(spark, "a"), _put_orders, batch="state-0")
    monkeypatch.setattr(tables, "swap", real)
    for root, account in ((roots[1], "b"), (roots[0], "a"), (roots[0], "a")):
        assert tables.rewrite(spark, root, "domestic_orders", _orders_of(spark, account), _put_orders, batch="state-0") == (1, 1)
        assert [r.account_id for r in tables.read_table(spark, root, "domestic_orders").collect()] == [account]


def test_a_retry_takes_the_stage_and_its_counts_not_the_input(spark, tmp_path, monkeypatch):
    root, real = str(tmp_path / "tables"), tables.swap
    tables.create(spark, root, "domestic_orders")
    monkeypatch.setattr(tables, "swap", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        tables.rewrite(spark, root, "domestic_orders", _orders_of(spark, "a"), _put_orders, batch="x#1")
    monkeypatch.setattr(tables, "swap", real)
    assert tables.rewrite(spark, root, "domestic_orders", _orders_of(spark, "z").limit(0), _put_orders, batch="x#1") == (1, 1)
    assert [r.account_id for r in tables.read_table(spark, root, "domestic_orders").collect()] == ["a"]
    # The stage is gone: the name may be used again.
    assert tables.rewrite(spark, root, "domestic_orders", _orders_of(spark, "z"), _put_orders, batch="x#1") == (1, 1)
    assert sorted(r.account_id for r in tables.read_table(spark, root, "domestic_orders").collect()) == ["a", "z"]


def test_a_stage_of_another_batch_is_refused(spark, tmp_path, monkeypatch):
    root, stage = str(tmp_path / "tables"), session.scratch_path(spark, "one")
    tables.create(spark, root, "domestic_orders")
    monkeypatch.setattr(tables, "stage_path", lambda *_: stage)
    monkeypatch.setattr(tables, "swap", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        tables.rewrite(spark, root, "domestic_orders", _orders_of(spark, "a"), _put_orders, batch="1")
    with pytest.raises(ValueError, match="staged for batch 1"):
        tables.rewrite(spark, root, "domestic_orders", _orders_of(spark, "a"), _put_orders, batch="2")


def test_a_swap_does_not_shuffle(spark, tmp_path, monkeypatch):
    root, plans, real = str(tmp_path / "tables"), [], tables.swap
    tables.create(spark, root, "domestic_orders")

    def watched(spark_, root_, name, merged):
        rows = spark_.read.parquet(merged)
        plans.append((rows._jdf.queryExecution().executedPlan().toString(), "month" in rows.columns))
        real(spark_, root_, name, merged)

    monkeypatch.setattr(tables, "swap", watched)
    tables.rewrite(spark, root, "domestic_orders", _orders_of(spark, "a"), _put_orders)
    assert plans and all("Exchange" not in plan and split for plan, split in plans)


@pytest.mark.parametrize("months", [1, 2])
def test_a_batch_of_one_month_is_written_where_it_was_merged(spark, tmp_path, months):
    """Its rows need not be gathered by month once more; those of several months are, in a file each."""
    root, merging = str(tmp_path / "tables"), "spark.sql.adaptive.coalescePartitions.enabled"
    rows = [("A", "KRX", dt.date(2024, 1 + i % months, 1 + i // 2), float(i), 1.0, 1.0, 1.0, 1, i) for i in range(50)]
    tables.create(spark, root, "price_history")
    spark.conf.set(merging, "false")
    try:
        tables.rewrite(spark, root, "price_history", spark.createDataFrame(rows, PRICE_IN),
                       lambda target, new: merge.overwrite_adjusted(target, new, now(), ["seq"]))
    finally:
        spark.conf.set(merging, "true")
    files = [len(list(part.glob("*.parquet"))) for part in (tmp_path / "tables/price_history").glob("month=2024-*")]
    assert files == [1, 1] if months == 2 else files[0] > 1
    out = {r.date: r.close for r in tables.read_table(spark, root, "price_history").collect()}
    assert out == {row[2]: row[6] for row in rows}


def test_compaction_leaves_what_a_batch_wrote_meanwhile(spark, tmp_path):
    out, rows = str(tmp_path / "partials"), "k STRING, v INT, at INT"

    def newest(df):
        return merge.one_per_key(df, ("k",), ["at"])

    def write(batch, *data):
        spark.createDataFrame(data, rows).write.mode("append").parquet(f"{out}/batch={batch}")

    def fold(df):
        # Batch 1 is run again while the rows are folded, and this time has one row more.
        if not (tmp_path / "again").exists():
            (tmp_path / "again").touch()
            write(1, ("late", 9, 9))
        return newest(df)

    write(0, ("a", 1, 1))
    write(1, ("a", 2, 2), ("b", 3, 1))
    jobs.compact_partials(spark, out, fold)
    assert sorted((r.k, r.v) for r in jobs.read_partials(spark, out, newest).collect()) == [("a", 2), ("b", 3), ("late", 9)]
    jobs.compact_partials(spark, out, newest)
    assert sorted((r.k, r.v) for r in jobs.read_partials(spark, out, newest).collect()) == [("a", 2), ("b", 3), ("late", 9)]


def test_reads_skip_the_files_of_other_months(spark, tmp_path):
    root = str(tmp_path / "tables")
    rows = [("A", "KRX", dt.date(2024, month, 1), 1.0, 1.0, 1.0, 1.0, 1, 1) for month in (1, 2, 3)]
    tables.append(spark.createDataFrame(rows, PRICE_IN), root, "price_history")
    some = tables.read_table(spark, root, "price_history", dt.date(2024, 2, 10), dt.date(2024, 2, 20))
    assert [str(r.date) for r in some.collect()] == ["2024-02-01"]
    assert "month" in some._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("PushedFilters")[0]


def test_insert_appends_what_is_missing(spark, tmp_path):
    root = str(tmp_path / "tables")
    tables.create(spark, root, "price_history")
    def put(*rows):
        return tables.insert(spark, root, "price_history", spark.createDataFrame(rows, PRICE_IN),
                             lambda target, new: merge.insert_prices(target, new, now(), ["seq"]))
    assert put(quote(1, 1.0, 1), quote(1, 2.0, 2), quote(2, 3.0, 3)) == 2
    assert put(quote(1, 9.0, 1), quote(3, 4.0, 2)) == 1


def test_scratch_is_only_cleared_inside_the_shared_folder(spark, tmp_path):
    with pytest.raises(ValueError):
        session.drop_scratch(spark, str(tmp_path))


def test_export_refuses_an_existing_folder(spark, tmp_path):
    out = str(tmp_path / "run")
    manifest = export.export(spark, {"a": spark.range(3), "b": spark.range(0)}, out)
    assert {r.table: r.rows for r in manifest.collect()} == {"a": 3, "b": 0}
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        export.export(spark, {"a": spark.range(3)}, out)


def test_an_export_writes_changed_parts_and_finds_broken_ones(spark, tmp_path):
    root, out, name = str(tmp_path / "tables"), str(tmp_path / "out"), "price_history"

    def put(*rows):
        frame = spark.createDataFrame([(s, "KRX", d, c, c, c, c, 1, False, dt.datetime(2024, 1, 1)) for s, d, c in rows], PRICE_HISTORY)
        tables.append(frame, root, name)

    def run():
        return {r.part: (r.rows, r.status) for r in export.export_changed(spark, root, [name], out).collect()}

    put(("A", dt.date(2024, 1, 1), 1.0), ("B", dt.date(2024, 1, 2), 2.0), ("A", dt.date(2024, 2, 1), 3.0), ("A", dt.date(2024, 3, 1), 4.0))
    assert run() == {"2024-01": (2, "exported"), "2024-02": (1, "exported"), "2024-03": (1, "exported")}
    assert set(v for _, v in run().values()) == {"unchanged"}
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / name).glob("month=2024-01/*.parquet")}
    put(("C", dt.date(2024, 2, 9), 3.0))
    session.delete_path(spark, f"{root}/{name}/month=2024-03")
    assert run() == {"2024-01": (2, "unchanged"), "2024-02": (2, "exported"), "2024-03": (0, "removed")}
    assert files == {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / name).glob("month=2024-01/*.parquet")}
    assert export.broken_parts(spark, out, [name]).count() == 0 and export.reload_checked(spark, out, name).count() == 4
    # A row that the manifest does not know of, and a part that is lost.
    export.exported(spark, out, name).limit(1).drop("month").write.mode("append").parquet(f"{out}/{name}/month=2024-01")
    session.delete_path(spark, f"{out}/{name}/month=2024-02")
    assert sorted(r.part for r in export.broken_parts(spark, out, [name]).collect()) == ["2024-01", "2024-02"]
    with pytest.raises(ValueError, match="2024-01, 2024-02"):
        export.reload_checked(spark, out, name)


def test_digests_tell_rows_not_their_order(spark):
    rows = spark.createDataFrame([("p", 1, "a"), ("p", 2, None), ("q", 2, None), (None, 3, "c")], "part string, n int, s string")
    told = {r.part: r.digest for r in export.digests(rows, "part").collect()}
    again = {r.part: r.digest for r in export.digests(rows.orderBy(F.desc("n")).repartition(3).select("s", "part", "n"), "part").collect()}
    assert told == again and len(set(told.values())) == 3
    twice = {r.part: r.digest for r in export.digests(rows.unionByName(rows).unionByName(rows), "part").collect()}
    assert not set(twice.values()) & set(told.values())


def test_all_tables_can_be_created_and_read(spark, tmp_path):
    for name, schema in TABLES.items():
        tables.create(spark, str(tmp_path), name)
        assert set(schema.fieldNames()) <= set(tables.read_table(spark, str(tmp_path), name).columns)
    assert len(TABLES) == 12


def test_latest_observation_prefers_the_exact_product(spark):
    day = dt.date(2026, 4, 23)
    def obs(i, product, hour):
        return (i, "1", product, "t", "domestic", day, day, dt.datetime(2026, 4, 23, hour), "{}")
    seen = spark.createDataFrame([obs("a", "01", 1), obs("b", None, 9), obs("c", "01", 2), obs("d", "01", 2), obs("e", "29", 9)], ORDER_HISTORY)
    asked = spark.createDataFrame([("1", p, "domestic", day, day) for p in ("01", "22", "29")],
                                  "account_id STRING, account_product_code STRING, market_type STRING, start_date DATE, end_date DATE")
    out = {r.account_product_code: r.id for r in reads.latest_observations(seen, asked).collect()}
    assert out == {"01": "d", "22": "b", "29": "e"}


def responses(spark, *payloads):
    rows = [(f"r{i}", f"{i}" * 8, "01", "brokerage", "krx", dt.date(2026, 4, 23), dt.datetime(2026, 4, 23, 9), p) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "id STRING, account_id STRING, account_product_code STRING, account_type STRING, market STRING, trade_date DATE, now TIMESTAMP_NTZ, payload STRING")


GOOD = json.dumps({"output1": [{"ODNO": "A-100", "pdno": "005930", "prdt_name": "삼성전자", "ord_dt": "2026-04-23", "ord_qty": "10", "tot_ccld_qty": "1,000",
                                "excg_id_dvsn_Cd": "KRX"}, {"pdno": "none"}]})


def calendar(spark):
    return dimensions.trading_calendar(spark.createDataFrame([(2026,)], "year INT"), spark.createDataFrame([], "date DATE, name STRING"))


def test_one_bad_response_does_not_stop_the_others(spark):
    run = orders.collect(responses(spark, GOOD, "busy", '{"output1": []}'), calendar(spark))
    outcomes = run.outcomes.orderBy("id").collect()
    assert [(r.status, r.order_count, r.canonical_write_count) for r in outcomes] == [("ok", 2, 1), ("error", None, None), ("ok", 0, 0)]
    row = run.orders.first()
    assert (row.order_no, row.symbol_name, row.order_qty, row.total_order_qty, row.filled_qty, row.exchange_id_code) == (
        "A-100", "삼성전자", 10, 10, 1000, "KRX")
    assert run.rejects.count() == 1 and run.observations.count() == 2
    counts = export.outcome_counts(run.outcomes).first()
    assert (counts["count"], counts.success_count, counts.error_count, counts.saved_count) == (3, 2, 1, 2)


def test_history_is_served_or_missed_then_replayed(spark):
    run = orders.collect(responses(spark, GOOD), calendar(spark))
    observed = tables.conform(run.observations, ORDER_HISTORY)
    empty = spark.createDataFrame([], DOMESTIC_ORDERS)
    day = dt.date(2026, 4, 23)
    asked = spark.createDataFrame([("0" * 8, "01", "domestic", day, day), ("0" * 8, "01", "domestic", day, dt.date(2026, 4, 24))],
                                  "account_id STRING, account_product_code STRING, market_type STRING, start_date DATE, end_date DATE")
    rows, coverage = orders.serve(asked, observed, empty)
    assert rows.count() == 0
    assert {(str(r.end_date), r.status) for r in coverage.collect()} == {("2026-04-23", "ok"), ("2026-04-24", "cache_miss")}
    stored = orders.replay(asked, observed, empty, now())
    assert stored.first().last_source == "order_history_backfill"
    assert orders.missing_from_canonical(asked, observed, stored).count() == 0
    shown = orders.history(stored, observed, "0" * 8, "01", day, day, symbol="005930").collect()
    assert [(r.order_no, r.order_branch_no, r.order_date) for r in shown] == [("A-100", None, "20260423")]
    assert orders.history(stored, observed, "0" * 8, "01", day, dt.date(2026, 4, 24)).count() == 0


def test_fallback_date_and_bad_date(spark):
    doc = json.dumps({"output1": [{"odno": "1"}, {"odno": "2", "ord_dt": "20269999"}]})
    rows = spark.createDataFrame([("a", "01", "t", "20260423", "o", dt.datetime(2026, 4, 23), doc)],
                                 "account_id STRING, account_product_code STRING, account_type STRING, fallback_date STRING, observation_id STRING, fetched_at TIMESTAMP_NTZ, payload STRING")
    good, bad = order_source.order_rows(rows)
    assert [(r.order_no, r.order_date) for r in good.collect()] == [("1", dt.date(2026, 4, 23))]
    assert [r.order_no for r in bad.collect()] == ["2"]


def test_streams_resume_and_keep_the_newest(spark, tmp_path):
    source, state, out = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "out")
    schema = "account_id STRING, snapshot_at TIMESTAMP_NTZ, total_eval_amt LONG"
    def put(*rows):
        spark.createDataFrame([(a, dt.datetime(2024, 1, d, h), v) for a, d, h, v in rows], schema).coalesce(1).write.mode("append").parquet(source)
    def last(rows):
        return jobs.last_per_window(rows, ["account_id"], "total_eval_amt")
    def answer():
        return {(r.account_id, r.window_start.day): r.total_eval_amt for r in jobs.read_partials(spark, out, last).collect()}
    def run():
        stream = jobs.read_files(spark, source, spark.read.parquet(source).schema)
        jobs.write_partials(stream, last, out, state).awaitTermination()
        return answer()
    put(("a", 1, 9, 1), ("a", 1, 10, 2), ("b", 1, 9, 7))
    assert run() == {("a", 1): 2, ("b", 1): 7}
    put(("a", 1, 11, 3), ("a", 2, 9, 4))
    assert run() == {("a", 1): 3, ("a", 2): 4, ("b", 1): 7}
    # A row of a month later, then one that comes a day late: neither is dropped.
    put(("a", 30, 9, 5))
    run()
    put(("b", 1, 23, 8), ("a", 1, 8, 9))
    assert run() == {("a", 1): 3, ("a", 2): 4, ("a", 30): 5, ("b", 1): 8}
    jobs.compact_partials(spark, out, last)
    assert len(list((tmp_path / "out").glob("batch=*"))) == 1
    assert answer() == {("a", 1): 3, ("a", 2): 4, ("a", 30): 5, ("b", 1): 8}
    put(("b", 1, 22, 1), ("c", 1, 1, 1))
    assert run() == {("a", 1): 3, ("a", 2): 4, ("a", 30): 5, ("b", 1): 8, ("c", 1): 1}


@pytest.mark.parametrize("files", [1, 10])
def test_streamed_orders_and_firsts_do_not_hang_on_batches(spark, tmp_path, files):
    source, root, out = (str(tmp_path / x) for x in ("in", "tables", "out"))
    fields = "account_id STRING, account_product_code STRING, account_type STRING, order_date DATE, order_branch_no STRING, order_no STRING, filled_qty LONG, seen_at TIMESTAMP_NTZ, place INT"
    def row(hour, filled, place=0):
        return ("12345678", "01", "brokerage", dt.date(2026, 4, 23), "", "A-1", filled, dt.datetime(2026, 4, 23, hour), place)
    for batch in ([row(12, 200), row(11, 5)], [row(9, 100)], [row(12, 300, 1), row(10, 7)]):
        spark.createDataFrame(batch, fields).coalesce(1).write.mode("append").parquet(source)
    tables.create(spark, root, "domestic_orders")
    schema = spark.read.parquet(source).schema
    jobs.upsert_stream(jobs.read_files(spark, source, schema, files_per_batch=files), root, "domestic_orders",
                       lambda target, new: merge.upsert_orders(target, new, now()), str(tmp_path / "state")).awaitTermination()
    assert [r.filled_qty for r in tables.read_table(spark, root, "domestic_orders").collect()] == [300]
    def first(rows):
        return jobs.first_per_key(rows, ["order_no"], ["seen_at", "place"])
    jobs.write_partials(jobs.read_files(spark, source, schema, files_per_batch=files), first, out,
                        str(tmp_path / "state2")).awaitTermination()
    assert [r.filled_qty for r in jobs.read_partials(spark, out, first).collect()] == [100]


def events_in_files(spark, folder, files=5):
    """A table of 60 events, ten of one key, in several files that each hold rows of all times."""
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i), i % 6, "view", float(i), "{}") for i in range(60)]
    events = spark.createDataFrame(rows, "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING")
    events.repartition(files).write.parquet(f"{folder}/events.parquet")
    return rows


def test_events_arrive_in_three_batches_however_many_files_their_table_has(spark, tmp_path):
    rows, out = events_in_files(spark, tmp_path), tmp_path / "out"
    jobs.write_partials(streams.arriving(Tables(spark, str(tmp_path))), lambda seen: seen, str(out),
                        str(tmp_path / "state")).awaitTermination()
    batches = [sorted(r.event_id for r in spark.read.parquet(str(path)).collect()) for path in sorted(out.glob("batch=*"))]
    assert len(batches) == 3 and batches[0][-1] == 59 and batches[2][0] == 0
    assert sorted(sum(batches, [])) == [row[0] for row in rows]


def test_two_streams_of_one_table_merge_three_batches_each(spark, tmp_path, monkeypatch):
    rows, merged, rewrite = events_in_files(spark, tmp_path), [], tables.rewrite
    monkeypatch.setattr(jobs, "rewrite", lambda *given, batch: merged.append(batch) or rewrite(*given, batch=batch))
    kept = QUERIES["stream_order_upsert_two_tables"](spark, str(tmp_path)).collect()
    assert len(merged) == len(set(merged)) == 6
    newest = {(f"{user:08d}", str(ts.date())): round(value * 100) for _i, ts, user, _kind, value, _props in rows}
    assert {(r.account_id, r.order_date): r.filled_amount for r in kept} == newest and len(kept) == len(newest)


def test_lookbacks_over_stored_tables_skip_the_files_of_earlier_months(spark, tmp_path):
    root = str(tmp_path / "tables")
    rows = [("x", "a", "t", dt.datetime(2024, month, d), d, None) for month in (1, 2, 3) for d in (1, 5, 9)]
    tables.append(spark.createDataFrame(rows, "id STRING, account_id STRING, account_type STRING, snapshot_at TIMESTAMP_NTZ, total_eval_amt LONG, balance_data STRING"),
                  root, "portfolio_snapshots")
    stored = tables.read_table(spark, root, "portfolio_snapshots")
    daily = curate.portfolio_daily(stored)
    answers = {
        "summary": portfolio.latest_summary_of_snapshots(stored, lookback_days=20, as_of="20240310"),
        "anomalies": portfolio.anomalies(daily, lookback_days=20, as_of="20240310"),
        "trend": portfolio.trend(daily, short_window=2, long_window=2, lookback_days=20, as_of="20240310"),
    }
    for name, answer in answers.items():
        filters = answer._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
        assert "month" in filters and "2024-02" in filters, name
        assert "month" not in answer.columns
    assert answers["trend"].count() == 2 and answers["summary"].first().total_eval_amt == 9


def test_number_zero_is_missing_and_the_text_is_not(spark):
    payload_text = json.dumps({"output1": [
        {"odno": "7", "ord_dt": "20260423", "rmn_qty": 0, "rjct_qty": "0", "tot_ord_qty": 0.0, "ord_qty": "5", "pdno": "a:0,b"},
        {"odno": 0, "ord_dt": "20260423"}]})
    raw = spark.createDataFrame([("1", "01", "t", "20260423", "o", dt.datetime(2026, 4, 23), payload_text)],
                                "account_id STRING, account_product_code STRING, account_type STRING, fallback_date STRING, observation_id STRING, fetched_at TIMESTAMP_NTZ, payload STRING")
    good, bad = order_source.order_rows(raw)
    row = good.first()
    assert (row.pending_qty, row.rejected_qty, row.total_order_qty, row.symbol) == (None, 0, 5, "a:0,b")
    assert bad.count() == 1
    assert raw.select(order_source.storable_count(F.col("payload"), F.col("fallback_date")).alias("n")).first().n == 1
