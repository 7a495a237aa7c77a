"""Payload shapes, files and dimensions."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from folioframe.functions import numbers, payload, text
from folioframe.plans.gate import collection_gate
from folioframe.sources import balances, dimensions, masters, prices


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("value, number, whole, strict, lenient", [
    ("1,234", 1234.0, 1234, 1234, 1234), ("1234.0", 1234.0, 1234, None, 1234), ("", None, None, None, None),
    (None, None, None, None, None), ("-", None, None, None, None), ("not-a-number", None, None, None, None),
    ("$5.9", 5.9, 5, None, None), ("-7.9%", -7.9, -7, None, None), ("0", 0.0, 0, 0, 0),
])
def test_numbers(spark, value, number, whole, strict, lenient):
    c = F.lit(value).cast("string")
    got = spark.range(1).select(numbers.parse_number(c), numbers.parse_int(c), numbers.strict_int(c), numbers.lenient_int(c)).first()
    assert tuple(got) == (number, whole, strict, lenient)


@pytest.mark.parametrize("doc, total", [
    *[({"output2": {name: f"{i},000"}}, i * 1000) for i, name in enumerate(balances.TOTAL_FIELDS, 1)],
    ({"output2": [{"tot_evlu_amt": "1,000"}]}, 1000), ({"output2": []}, None), ({}, None), ({"output2": "x"}, None),
    ({"output2": {"tot_evlu_amt": "bad", "tot_asst_amt": "5"}}, None), ({"output2": {"tot_evlu_amt": 0, "tot_asst_amt": 5}}, 5),
    ({"output2": {"tot_evlu_amt": "0", "tot_asst_amt": "5"}}, 0), ({"output2": {"tot_evlu_amt": 7.9}}, 7),
])
def test_total_value(spark, doc, total):
    assert one(spark, balances.total_value(F.lit(json.dumps(doc)))) == total


def test_odd_elements_do_not_spoil_a_list(spark):
    doc = json.dumps({"output1": [{"a": "1"}, 5, "x", None, {"a": {"b": 1}}, {"A": "2", "a": ""}]})
    row = payload.all_spellings("a")
    df = spark.createDataFrame([(doc,), ("<html>",), ('{"output1": "none"}',)], "doc STRING")
    out = row.explode(df, payload.items(F.col("doc"), "output1")).select("_place", row.pick("a").alias("a"), "_text").collect()
    assert [(r._place, r.a) for r in out] == [(0, "1"), (1, '{"b":1}'), (2, "2")]
    assert json.loads(out[2]._text) == {"A": "2", "a": ""}


def test_domestic_prices_fall_back_to_the_other_list_and_date(spark):
    day = {"stck_clpr_date": "20240102", "stck_clpr": "1,000", "acml_vol": "5"}
    rows = spark.createDataFrame([
        ("A", json.dumps({"output2": [], "output": [day, {"stck_clpr": "1"}]})), ("B", json.dumps({"rt_cd": "1"})),
    ], "symbol STRING, payload STRING")
    out = prices.typed_prices(prices.domestic_price_rows(rows)).collect()
    assert [(r.symbol, r.exchange, r.date, r.close, r.volume, r.open) for r in out] == [("A", "KRX", dt.date(2024, 1, 2), 1000.0, 5, None)]


def test_json_text_that_is_not_json_is_kept(spark):
    assert one(spark, text.decode_json(F.lit("plain")).cast("string")) == "plain"
    assert one(spark, F.to_json(text.decode_json(F.lit('{"b":1}')))) == '{"b":1}'


@pytest.mark.parametrize("number, masked", [("11111111", "11****11"), ("1234", "****"), ("12345", "12*45"), ("", "")])
def test_mask(spark, number, masked):
    assert one(spark, text.mask(F.lit(number))) == masked


def test_times_render_like_iso(spark):
    assert one(spark, text.iso_time(F.lit(dt.datetime(2024, 1, 2, 3, 4, 5)))) == "2024-01-02T03:04:05"
    assert one(spark, text.iso_time(F.lit(dt.datetime(2024, 1, 2, 3, 4, 5, 60)))) == "2024-01-02T03:04:05.000060"


@pytest.mark.parametrize("listing, tail", [("KOSPI", 228), ("KOSDAQ", 222), ("KONEX", 184)])
def test_layouts_fit_their_tail(listing, tail):
    layout = masters.LAYOUTS[listing]
    assert layout.tail == tail
    ends = [first + width for _, first, width in layout.fields]
    assert max(ends) <= tail and all(first >= end for (_, first, _), end in zip(layout.fields[1:], ends))


def test_fixed_width_lines_are_cut_by_bytes(spark, tmp_path):
    layout = masters.Layout(4, (("group_code", 0, 2), ("etp_code", 2, 2)))
    line = b"123456789" + b"STD123456789" + "한글ETF".encode("cp949") + b"FE01"
    blank = b" " * 9 + b"STD000000000" + b"none" + b"FE01"
    broken = b"A0000001 " + b"STD000000001" + b"ab\xff" + b"EF02"
    (tmp_path / "list.mst").write_bytes(b"\r\n".join([line, blank, broken]) + b"\r\n")
    out = masters.parse_fixed_width(spark.read.text(str(tmp_path / "list.mst")), layout).orderBy("symbol").collect()
    assert [(r.symbol, r.standard_code, r.name, r.group_code, r.etp_code) for r in out] == [
        ("123456789", "STD123456789", "한글ETF", "FE", "01"), ("A0000001", "STD000000001", "ab", "EF", "02")]
    raw = json.loads(out[0].raw_data)
    assert raw["name"] == "한글ETF" and raw["tail"] == "FE01"


def test_account_types(spark):
    cases = [("ria", "01", "ria"), (None, "01", "brokerage"), (None, "22", "pension"), (None, "29", "irp"), ("odd", "99", "unknown")]
    df = spark.createDataFrame([(str(i), label, code) for i, (label, code, _) in enumerate(cases)], "account_id STRING, label STRING, product_code STRING")
    out = dimensions.account_dimension(df).orderBy("account_id").collect()
    assert [r.account_type for r in out] == [expected for _, _, expected in cases]


@pytest.fixture(scope="module")
def calendar(spark):
    holidays = spark.createDataFrame([(dt.date(2026, 1, 1), "신정"), (dt.date(2026, 12, 25), "성탄절")], "date DATE, name STRING")
    years = spark.createDataFrame([(2026,), (2028,)], "year INT")
    return dimensions.trading_calendar(years, holidays)


def test_calendar_rules(calendar):
    days = {str(r.trade_date): r for r in calendar.collect()}
    assert len(days) == 365 + 366
    assert days["2026-01-01"].note == "공휴일 휴장: 신정"
    assert days["2026-01-03"].note == "주말 휴장" and days["2026-01-03"].open_time_local is None
    assert days["2026-05-01"].note == "근로자의 날 휴장" and not days["2026-05-01"].is_open
    assert days["2026-12-31"].note == "연말 휴장"
    assert days["2028-12-29"].note == "연말 휴장"  # the 31st is a Sunday
    assert days["2026-04-23"].is_open and days["2026-04-23"].close_time_local == "15:30"


@pytest.mark.parametrize("day, clock, reason", [
    ("2026-04-23", "2026-04-23 06:34:00", "before_close_grace_window"), ("2026-04-23", "2026-04-23 06:35:00", "ready"),
    ("2026-05-01", "2026-05-01 06:35:00", "market_closed"), ("2026-04-23", "2026-04-22 01:00:00", "ready"),
    ("2025-04-23", "2025-04-23 09:00:00", "calendar_missing"),
])
def test_gate(spark, calendar, day, clock, reason):
    asked = spark.createDataFrame([("krx", dt.date.fromisoformat(day), dt.datetime.fromisoformat(clock))],
                                  "market STRING, trade_date DATE, now TIMESTAMP_NTZ")
    row = collection_gate(asked, calendar).first()
    assert row.reason == reason and row.status == ("collect" if reason == "ready" else "skipped")


@pytest.mark.parametrize("text, kept", [
    ('{"a":0}', {}), ('{"a":0,"b":0.0}', {}), ('{"a": 0 , "b":1}', {"b": 1}), ('{"b":1,"a":-0.00,"c":0e5}', {"b": 1}),
    ('{"a":"0","b":":0,","c":"x\\":0,"}', {"a": "0", "b": ":0,", "c": 'x":0,'}), ('{"a":10,"b":0.5,"c":05}', None),
    ('{"x":{"a":0},"l":[0,0],"y":0}', {"x": {}, "l": [0, 0]}), ('{"a":null,"b":false,"c":0}', {"a": None, "b": False}),
])
def test_members_of_number_zero_are_left_out(spark, text, kept):
    out = one(spark, payload.without_zeros(F.lit(text)))
    assert out == text if kept is None else json.loads(out) == kept


def test_stored_documents_read_like_texts(spark):
    """Orders and holdings from responses parsed once equal those from their texts; no read parses text."""
    from folioframe.operators import append
    from folioframe.session import materialize, scratch_path
    from folioframe.sources import balances, orders

    lists = [
        '{"output1":[{"odno":"1","ord_dt":"20240102","ord_qty":"1,000","tot_ord_qty":0,"rmn_qty":"0","cncl_yn":"y","pdno":5930},'
        '{"ODNO":"2","ORD_DT":"2024-01-03","EXCG_ID_DVSN_CD":"KRX","tot_ccld_qty":0.0,"ccld_qty":7},{"odno":0},{"odno":"0","ord_dt":""},"text",7,null]}',
        '{"output1":{"odno":"9"}}', '{"output1":[]}', "<html>", "", None, '{"output1":[{"odno":"3","odno":"4"}]}', "[1]",
        '{"output1":[{"odno":" ","ord_dt":"bad","excg_id_dvsn_Cd":"NXT","ord_tmd":null,"prdt_name":"이름 \\"q\\" \\u00e9"}]}',
    ]
    rows = [("a", "01", "isa", "20240110", f"o{n}", dt.datetime(2024, 1, 1), doc) for n, doc in enumerate(lists)]
    frame = spark.createDataFrame(rows, "account_id string, account_product_code string, account_type string, fallback_date string, "
                                        "observation_id string, fetched_at timestamp_ntz, payload string")
    stored = materialize(append.documents(frame, "payload"), scratch_path(spark, "documents"))
    assert stored.filter("unread IS NOT NULL").count() == 3
    for told, want in zip(orders.order_rows_of_documents(stored), orders.order_rows(frame), strict=True):
        # An object with a name twice is no document: it stays unread.
        want = want.filter("last_order_history_id != 'o6'")
        assert sorted(map(str, told.drop("raw_data").collect())) == sorted(map(str, want.drop("raw_data").collect()))
        assert "from_json" not in told._jdf.queryExecution().optimizedPlan().toString()
    balance = spark.createDataFrame([(1, '{"output1":[{"pdno":" A ","prdt_name":"x","hldg_qty":"2","evlu_amt":"1,500.9"},{"pdno":"B","evlu_amt":0},'
                                         '{"pdno":"C","evlu_amt":12}]}'), (2, None), (3, '{"output1":"no"}')], "n int, balance_data string")
    kept = materialize(append.documents(balance, "balance_data"), scratch_path(spark, "documents"))
    told = balances.domestic_holdings_of_documents(kept)
    assert sorted(map(str, told.drop("raw_data", "unread").collect())) == sorted(map(str, balances.domestic_holdings(balance).drop("raw_data").collect()))
    assert told.count() == 2 and "from_json" not in told._jdf.queryExecution().optimizedPlan().toString()
