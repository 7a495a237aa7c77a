"""Payload readers, file scans and generated tables, over responses built row by row from the given tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioframe.operators import append, export, merge
from folioframe.registry.core import ctes, query
from folioframe.registry.standins import ACCOUNTS, CALENDAR, HOLIDAYS, MASTER, cents_sql, symbol_sql
from folioframe.session import materialize, scratch_path
from folioframe.sources import balances, dimensions, masters, prices

_CENTS = cents_sql("value")
# A price text with a thousands comma, and what it means.
_COMMA = f"concat(CAST(({_CENTS} - {_CENTS} % 1000) / 1000 AS INTEGER), ',', lpad(CAST({_CENTS} % 1000 AS VARCHAR(9)), 3, '0'))"
_DAY = "replace(CAST(CAST(ts AS DATE) AS VARCHAR(10)), '-', '')"


def _json(**members: Column) -> Column:
    return F.to_json(F.struct(*[value.alias(name) for name, value in members.items()]))


def _object(**members) -> Column:
    return F.struct(*[(value if isinstance(value, Column) else F.lit(value)).alias(name)
                      for name, value in members.items()])


def _zeroed(doc: Column) -> Column:
    """The marked texts as numbers 0, which count as missing, or as a text that is no whole number."""
    return F.replace(doc, F.lit('"#"'), F.when(F.col("event_id") % 12 == 0, F.lit("0")).otherwise(F.lit('"12.5"')))


def _events(t):
    return t.read("events").withColumns({"comma": F.expr(_COMMA), "day": F.expr(_DAY)})


_PRICE_TAIL = "CAST({c} AS DOUBLE) AS open, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST({c} AS DOUBLE) END AS high, CAST(1.5 AS DOUBLE) AS low, CAST({c} AS DOUBLE) AS close, CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id END AS volume".format(c=_CENTS)


@query("domestic_price_rows", "A1 J3", f"""
SELECT {symbol_sql('user_id')} AS symbol, 'KRX' AS exchange, CAST(ts AS DATE) AS date, {_PRICE_TAIL}, event_id FROM events
UNION ALL
SELECT {symbol_sql('user_id')}, 'KRX', CAST(ts AS DATE), NULL, NULL, NULL, {_CENTS}, NULL, event_id FROM events""",
       dates="date")
def _(t):
    first = dict(stck_oprc=F.col("comma"), stck_hgpr=F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("comma")),
                 stck_lwpr=F.lit("1.5"), stck_clpr=F.col("comma"),
                 acml_vol=F.when(F.col("event_id") % 6 == 0, F.lit("#")).otherwise(F.col("event_id").cast("string")))
    blank = {name: F.lit(None).cast("string") for name in ("stck_oprc", "stck_hgpr", "stck_lwpr", "acml_vol")}
    none = F.lit(None).cast("string")
    listed = F.array(
        _object(stck_bsop_date=F.col("day"), stck_clpr_date=none, **first),
        _object(stck_bsop_date=F.lit(""), stck_clpr_date=F.col("day"), **{**first, **blank, "stck_clpr": F.col("comma")}),
        _object(stck_bsop_date=none, stck_clpr_date=none, **first),
    )
    empty = F.array_remove(F.array(listed[0]), listed[0])
    doc = F.when(F.col("event_id") % 4 == 0, _json(output2=empty, output=listed)).otherwise(_json(output2=listed))
    rows = _events(t).select(F.expr(symbol_sql("user_id")).alias("symbol"), _zeroed(doc).alias("payload"), "event_id")
    return prices.typed_prices(prices.domestic_price_rows(rows))


@query("overseas_price_rows", "A2 B1", f"""
SELECT {symbol_sql('user_id')} AS symbol, upper(substring(event_type, 1, 3)) AS exchange, CAST(ts AS DATE) AS date, {_PRICE_TAIL}, event_id
FROM events""", dates="date")
def _(t):
    first = dict(open=F.col("comma"), high=F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("comma")),
                 low=F.lit("1.5"), clos=F.col("comma"),
                 tvol=F.when(F.col("event_id") % 6 == 0, F.lit("#")).otherwise(F.col("event_id").cast("string")))
    listed = F.array(_object(xymd=F.col("day"), **first), _object(xymd=F.lit("20240230"), **first),
                     _object(xymd=F.lit(""), **first))
    rows = _events(t).select(
        F.expr(symbol_sql("user_id")).alias("symbol"), F.upper(F.substring("event_type", 1, 3)).alias("exchange"),
        _zeroed(_json(output2=listed)).alias("payload"), "event_id",
    )
    good, _bad = merge.split_bad(prices.typed_prices(prices.overseas_price_rows(rows)), "date")
    return good


@query("exchange_rate_rows", "A3", f"""
SELECT concat('C', CAST(user_id AS VARCHAR)) AS currency, 'D' AS period, CAST(ts AS DATE) AS date, CAST({_CENTS} AS DOUBLE) AS rate, event_id FROM events
UNION ALL SELECT concat('C', CAST(user_id AS VARCHAR)), 'D', CAST(ts AS DATE), 7, event_id FROM events""", dates="date")
def _(t):
    none = F.lit(None).cast("string")

    def item(first, second, index, close):
        return _object(stck_bsop_date=first, xymd=second, ovrs_nmix_prpr=index, clos=close)

    listed = F.array(
        item(F.col("day"), none, F.col("comma"), F.lit("9")), item(none, F.col("day"), F.lit(""), F.lit("7")),
        item(F.col("day"), none, none, F.lit("")), item(none, none, F.lit("5"), none),
    )
    rows = _events(t).select(F.concat(F.lit("c"), "user_id").alias("currency"), F.lit("D").alias("period"),
                             _json(output2=listed).alias("payload"), "event_id")
    return prices.typed_rates(prices.rate_rows(rows))


def deposits(t):
    """Present-balance responses: one customer's balance in two currencies, totals and rates."""
    amount = F.round("c_acctbal", 2).cast("decimal(18,2)").cast("string")
    number = F.col("c_custkey").cast("string")
    currency_rows = F.array(
        _object(crcy_cd="USD", frcr_dncl_amt_2=number, frcr_drwg_psbl_amt_1=amount, frcr_evlu_amt2="1,000",
                frst_bltn_exrt="1300.5"),
        _object(crcy_cd="VND", frcr_dncl_amt_2="-", frcr_drwg_psbl_amt_1="", frcr_evlu_amt2=number, frst_bltn_exrt="0.05"),
        _object(crcy_cd="", frcr_dncl_amt_2="1", frcr_drwg_psbl_amt_1="1", frcr_evlu_amt2="1", frst_bltn_exrt="1"),
    )
    totals = _object(
        dncl_amt=number, tot_dncl_amt=F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(number, F.lit(",000"))),
        frcr_dncl_amt_2="5", frcr_use_psbl_amt="250", wdrw_psbl_tot_amt="1",
        tot_asst_amt=F.when(F.col("c_custkey") % 4 == 0, F.lit(None)).otherwise(amount), cma_evlu_amt="0",
        usd_frst_bltn_exrt=F.when(F.col("c_custkey") % 5 == 0, "-").otherwise("1,400.5"), hkd_frst_bltn_exrt="180.2",
        jpy_frst_bltn_exrt="9.1", cny_frst_bltn_exrt="",
    )
    return t.read("customer").select("c_custkey", _json(output2=currency_rows, output3=totals).alias("payload"))


@query("deposit_totals", "A4", """
SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS krw_cash,
       CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat(c_custkey, ',000') END AS total_cash, '250' AS usable, 3 AS currencies FROM customer""")
def _(t):
    return balances.reshape_deposit(deposits(t)).select(
        "c_custkey", F.col("totals")["예수금액"].alias("krw_cash"), F.col("totals")["총예수금액"].alias("total_cash"),
        F.col("totals")["외화사용가능금액"].alias("usable"), F.size("currency_rows").alias("currencies"),
    )


@query("deposit_pair_rates", "A4", """
SELECT c_custkey, unnest(['USD/KRW', 'HKD/KRW', 'JPY/KRW', 'CNY/KRW']) AS pair,
       unnest([CASE WHEN c_custkey % 5 = 0 THEN '-' ELSE '1,400.5' END, '180.2', '9.1', '']) AS rate FROM customer""")
def _(t):
    return balances.pair_rate_rows(balances.reshape_deposit(deposits(t)))


@query("deposit_fx_rates", "D6", """
SELECT c_custkey, unnest(['USD', 'HKD', 'JPY', 'VND']) AS currency,
       unnest([CASE WHEN c_custkey % 5 = 0 THEN 1300.5e0 ELSE 1400.5e0 END, 180.2e0, 9.1e0, 0.05e0]) AS rate FROM customer""")
def _(t):
    return balances.fx_rates(balances.reshape_deposit(deposits(t)), ["c_custkey"])


@query("deposit_cash_rows", "G13", """
SELECT c_custkey, unnest(['USD', 'VND', NULL]) AS currency, unnest([CAST(c_custkey AS DOUBLE), NULL, 1e0]) AS cash_foreign,
       unnest([CAST(CAST(round(c_acctbal, 2) AS DECIMAL(18, 2)) AS DOUBLE), NULL, 1e0]) AS withdrawable_foreign,
       unnest([1000, c_custkey, 1]) AS cash_krw, unnest([1300.5e0, 0.05e0, 1e0]) AS fx_rate FROM customer""")
def _(t):
    return balances.cash_rows(balances.reshape_deposit(deposits(t)))


@query("deposit_cash_summary", "G13", """
SELECT *, coalesce(total_cash_amt_krw, foreign_cash_amt_krw + krw_cash_amt_krw) AS cash_from_fields_amt_krw
FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(trunc(round(c_acctbal, 2)) AS BIGINT) END AS total_asset_amt_krw,
             CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(concat(c_custkey, '000') AS BIGINT) END AS total_cash_amt_krw,
             CAST(250 AS BIGINT) AS foreign_cash_amt_krw, c_custkey AS krw_cash_amt_krw FROM customer) AS c""")
def _(t):
    return balances.cash_summary(balances.reshape_deposit(deposits(t)))


def _balances(t):
    value = F.concat(F.expr(cents_sql("l_extendedprice")).cast("string"), F.lit(".9"))

    def item(symbol, amount):
        return _object(pdno=symbol, prdt_name=F.concat(F.lit(" part "), F.col("l_partkey").cast("string")),
                       evlu_amt=amount, hldg_qty=F.col("l_quantity").cast("string"))

    symbol = F.concat(F.lit(" "), F.col("l_partkey").cast("string"))
    listed = F.array(item(symbol, value), item(F.lit(" "), value), item(symbol, F.lit("0")), item(symbol, F.lit("-")))
    return t.read("lineitem").select("l_orderkey", "l_linenumber", _json(output1=listed).alias("balance_data"))


_HOLDINGS = f"""
SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS symbol, concat('part ', l_partkey) AS name, l_quantity AS quantity,
       {cents_sql('l_extendedprice')} AS value_krw FROM lineitem"""


@query("domestic_holding_rows", "A5", _HOLDINGS)
def _(t):
    return balances.domestic_holdings(_balances(t)).drop("raw_data")


@query("domestic_holding_rows_of_documents", "A5 B7", _HOLDINGS)
def _(t):
    """From responses that were parsed when they were stored."""
    stored = materialize(append.documents(_balances(t), "balance_data"), scratch_path(t.spark, "documents"))
    return balances.domestic_holdings_of_documents(stored, raw=False).drop("unread")


@query("overseas_holding_rows", "A6 J17", f"""
SELECT l_orderkey, l_linenumber, 'NASD' AS exchange, CAST(l_partkey AS VARCHAR) AS symbol, 'us' AS name, 'EUR' AS currency,
       l_quantity AS quantity, CAST({cents_sql('l_extendedprice')} AS DOUBLE) AS value_foreign, 12.5e0 AS profit_foreign, -3.25e0 AS profit_rate_pct FROM lineitem
UNION ALL
SELECT l_orderkey, l_linenumber, 'TKSE', CAST(l_partkey AS VARCHAR), 'jp', 'JPY', 4, l_quantity, NULL, NULL FROM lineitem
WHERE l_quantity > 0""")
def _(t):
    value = F.expr(cents_sql("l_extendedprice")).cast("string")
    quantity, symbol = F.col("l_quantity").cast("string"), F.col("l_partkey").cast("string")
    nasdaq = F.array(
        _object(ovrs_pdno=symbol, ovrs_item_name="us", tr_crcy_cd="EUR", ovrs_cblc_qty=quantity, ovrs_stck_evlu_amt=value,
                frcr_evlu_pfls_amt="$12.5", evlu_pfls_rt="-3.25%"),
        _object(ovrs_pdno=symbol, ovrs_item_name="us", tr_crcy_cd="EUR", ovrs_cblc_qty=quantity, ovrs_stck_evlu_amt="0",
                frcr_evlu_pfls_amt="", evlu_pfls_rt=""),
    )
    tokyo = F.array(_object(ovrs_pdno=symbol, ovrs_item_name="jp", tr_crcy_cd="", ovrs_cblc_qty="-", ord_psbl_qty="4",
                            ovrs_stck_evlu_amt="-", frcr_evlu_amt2=quantity))
    doc = _json(NASD=_object(output1=nasdaq), TKSE=_object(output1=tokyo), message=F.lit("partial"))
    rows = t.read("lineitem").select("l_orderkey", "l_linenumber", doc.alias("balance_data"))
    return balances.overseas_holdings(rows).drop("raw_data")


_MASTER_CLEAN = ctes(MASTER) + """
SELECT symbol, market, standard_code, name, nullif(group_code, '') AS group_code, nullif(etp_code, '') AS etp_code,
       nullif(idx_large_code, '') AS idx_large_code, nullif(idx_mid_code, '') AS idx_mid_code,
       nullif(idx_small_code, '') AS idx_small_code FROM master"""


@query("staged_master_scan", "A8", _MASTER_CLEAN)
def _(t):
    rows = t.master()
    blank = rows.withColumn("symbol", F.lit(""))
    no_market = rows.withColumn("market", F.when(F.col("group_code") == "FE", "").otherwise(F.lit(None).cast("string")))
    path = scratch_path(t.spark, "staged-master")
    no_market.unionByName(blank).write.json(path)
    return masters.read_staged_master(t.spark, path).drop("raw_data")


def _cp949_lines(t, layout):
    """Listing lines as raw bytes, the name in the Korean charset; the tail's letters tell their place in it."""
    masters.allow_korean(t.spark)
    name = F.encode(F.concat(F.lit("한글 "), F.col("p_name")), "x-windows-949")
    tail = F.concat(F.rpad(F.substring("p_brand", 7, 2), 2, " "), F.lit("1"), F.lpad(F.col("p_size").cast("string"), 4, "0"))
    line = F.concat(
        F.rpad(F.expr(symbol_sql("p_partkey")), 9, " ").cast("binary"),
        F.rpad(F.concat(F.lit("KR"), F.col("p_partkey").cast("string")), 12, " ").cast("binary"),
        name, F.rpad(tail, layout.tail, "abcdefghijklmnopqrstuvwxyz").cast("binary"),
    )
    return t.read("part").select(line.cast("string").alias("value"))


@query("fixed_width_master_scan", "A9", f"""
SELECT listing, {symbol_sql('p_partkey')} AS symbol, 'KRX' AS market, concat('KR', CAST(p_partkey AS VARCHAR)) AS standard_code,
       trim(concat('한글 ', p_name)) AS name, trim(substring(p_brand, 7, 2)) AS group_code,
       CASE listing WHEN 'KOSPI' THEN 'p' WHEN 'KOSDAQ' THEN 'l' END AS etp_code,
       CASE WHEN listing <> 'KONEX' THEN lpad(CAST(p_size AS VARCHAR), 4, '0') END AS idx_large_code,
       CASE WHEN listing <> 'KONEX' THEN 'abcd' END AS idx_mid_code,
       CASE WHEN listing <> 'KONEX' THEN 'efgh' END AS idx_small_code
FROM part, (VALUES ('KOSPI'), ('KOSDAQ'), ('KONEX')) AS listings(listing)""")
def _(t):
    read = None
    for listing, layout in masters.LAYOUTS.items():
        path = scratch_path(t.spark, f"listing-{listing}")
        _cp949_lines(t, layout).write.text(path)
        rows = masters.read_fixed_width_master(t.spark, path, listing).drop("raw_data").withColumn("listing", F.lit(listing))
        read = rows if read is None else read.unionByName(rows)
    return read


@query("trading_calendar", "A10", ctes(CALENDAR) + "SELECT * FROM calendar", dates="trade_date")
def _(t):
    return dimensions.trading_calendar(t.years(), t.holidays()).drop("raw_data")


@query("year_end_closures", "A11", ctes(CALENDAR) + "SELECT CAST(year AS INTEGER) AS year, closure_date FROM closures",
       dates="closure_date")
def _(t):
    return dimensions.year_end_closures(t.years(), t.holidays())


@query("orders_by_market_day", "D7 C8", ctes(CALENDAR) + """
SELECT is_open, note, count(*) AS orders FROM orders LEFT JOIN calendar ON trade_date = CAST(o_orderdate AS DATE) GROUP BY is_open, note""")
def _(t):
    days = dimensions.trading_calendar(t.years(), t.holidays()).select("trade_date", "is_open", "note")
    per_day = t.read("orders").groupBy(F.col("o_orderdate").cast("date").alias("trade_date")).agg(
        F.count(F.lit(1)).alias("orders"))
    return per_day.join(days, "trade_date", "left").groupBy("is_open", "note").agg(F.sum("orders").alias("orders"))


@query("account_dimension", "A13 J15", ctes(ACCOUNTS) + """
SELECT account_id, label, product_code,
       coalesce(label, CASE product_code WHEN '01' THEN 'brokerage' WHEN '22' THEN 'pension' WHEN '29' THEN 'irp' ELSE 'unknown' END) AS account_type,
       CASE label WHEN 'ria' THEN '위험자산 일임' WHEN 'isa' THEN 'ISA' WHEN 'brokerage' THEN '일반 위탁' WHEN 'irp' THEN 'IRP 퇴직연금'
                  WHEN 'pension' THEN '연금저축' END AS display_name,
       concat(substring(account_id, 1, 2), repeat('*', length(account_id) - 4), right(account_id, 2)) AS masked_number
FROM accounts""")
def _(t):
    return dimensions.account_dimension(t.accounts())


@query("parquet_reload", "A12 B13", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    out = scratch_path(t.spark, "export")
    export.export(t.spark, {"orders": t.read("orders").select("o_orderkey", "o_custkey", "o_totalprice")}, out)
    return export.exported(t.spark, out, "orders")


@query("export_manifest", "B13 E9", """
SELECT 'orders' AS "table", count(*) AS rows, 'orders' AS path, 'parquet' AS format FROM orders UNION ALL
SELECT 'lineitem', count(*), 'lineitem', 'parquet' FROM lineitem UNION ALL
SELECT 'part', count(*), 'part', 'parquet' FROM part""")
def _(t):
    tables = {name: t.read(name) for name in ("orders", "lineitem", "part")}
    return export.export(t.spark, tables, scratch_path(t.spark, "export")).drop("created_at")


@query("row_counts", "E9 A12", """
SELECT 'orders' AS "table", count(*) AS rows FROM orders UNION ALL SELECT 'events', count(*) FROM events""")
def _(t):
    return export.row_counts({name: t.read(name) for name in ("orders", "events")})


@query("holidays_per_year", "A10 I2", ctes(HOLIDAYS) + "SELECT CAST(year(date) AS INTEGER) AS year, count(DISTINCT date) AS days FROM holidays GROUP BY 1")
def _(t):
    return t.holidays().groupBy(F.year("date").alias("year")).agg(F.count_distinct("date").alias("days"))
