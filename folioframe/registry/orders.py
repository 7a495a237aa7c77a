"""Order responses: normalisation, gating, collection, replay and reads from what is stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.operators import append, export, merge, tables
from folioframe.plans import gate, orders
from folioframe.registry.core import ctes, query
from folioframe.registry.merges import before, now
from folioframe.registry.standins import CALENDAR, account_sql, cents_sql, kind_sql, product_sql
from folioframe.schemas import DOMESTIC_ORDERS, ORDER_HISTORY
from folioframe.session import materialize, scratch_path
from folioframe.sources import dimensions
from folioframe.sources import orders as source


def _document(upper):
    """One order's response: the order itself, one without a number, and a bare text in the list.

    Member names are in capitals where `upper` says so; the date is missing for some.
    """
    def name(text):
        return F.when(upper, F.upper(F.lit(text))).otherwise(F.lit(text))

    key = F.col("o_orderkey").cast("string")
    amount = F.expr(cents_sql("o_totalprice"))
    day = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    members = {
        "ord_dt": day, "ord_gno_brno": F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("001"), "odno": key,
        "pdno": F.concat(F.lit("s"), (F.col("o_orderkey") % 50).cast("string")), "item_name": F.col("o_orderpriority"),
        "sll_buy_dvsn_cd": F.col("o_orderstatus"), "ord_qty": F.lit("1,000"),
        "tot_ccld_amt": amount.cast("string"), "rmn_qty": F.lit("12.5"), "ccld_qty": key,
        "cncl_yn": F.when(F.col("o_orderkey") % 2 == 0, "y").otherwise("N"),
        "orgn_odno": F.when(F.col("o_orderkey") % 9 == 0, key).otherwise(""), "sll_buy_dvsn_cd_name": F.lit("side"),
        "ord_dvsn_cd": F.substring("o_orderpriority", 1, 1), "ord_dvsn_name": F.col("o_orderpriority"),
        "ord_tmd": F.lpad((F.col("o_orderkey") % 240000).cast("string"), 6, "0"), "ord_unpr": amount.cast("string"),
        "avg_prvs": F.lit(""), "pchs_avg_pric": amount.cast("string"), "cnc_cfrm_qty": F.lit("3"), "ccld_cndt_name": F.lit("none"),
        "excg_dvsn_cd": F.lit("KRX"), "ord_orgno": key,
    }
    good = F.create_map(*[item for text, value in members.items() for item in (name(text), value)])
    # Numbers 0, which count as missing: a quantity, a first candidate, and the number of an order.
    zeros = F.when(F.col("o_orderkey") % 4 == 0, ',"tot_ord_qty":0,"rjct_qty":0}').otherwise(',"rjct_qty":"0"}')
    with_zeros = F.concat(F.regexp_replace(F.to_json(good), "}$", ""), zeros)
    bad = F.when(F.col("o_orderkey") % 2 == 0, '{"pdno":"none","odno":""}').otherwise('{"pdno":"none","odno": 0}')
    return F.concat(F.lit('{"output1":['), with_zeros, F.lit(","), bad, F.lit(',"text"]}'))


def responses(t):
    return t.read("orders").select(
        F.expr(account_sql("o_custkey")).alias("account_id"), F.expr(product_sql("o_custkey")).alias("account_product_code"),
        F.expr(kind_sql("o_custkey")).alias("account_type"), F.date_format("o_orderdate", "yyyyMMdd").alias("fallback_date"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("observation_id"), F.col("o_orderdate").alias("fetched_at"),
        _document(F.col("o_orderkey") % 2 == 1).alias("payload"),
    )


_NORMAL = f"""normal AS (SELECT {account_sql('o_custkey')} AS account_id, {product_sql('o_custkey')} AS account_product_code,
    {kind_sql('o_custkey')} AS account_type, CAST(o_orderdate AS DATE) AS order_date,
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '001' END AS order_branch_no, CAST(o_orderkey AS VARCHAR) AS order_no,
    concat('s', CAST(o_orderkey % 50 AS VARCHAR)) AS symbol, o_orderpriority AS symbol_name, o_orderstatus AS side_code,
    CAST(1000 AS BIGINT) AS order_qty, CAST(1000 AS BIGINT) AS total_order_qty, o_orderkey AS filled_qty, {cents_sql('o_totalprice')} AS filled_amount,
    CAST(NULL AS BIGINT) AS pending_qty, o_orderkey % 2 = 0 AS is_cancelled, concat('o', o_orderkey) AS last_order_history_id,
    CASE WHEN o_orderkey % 9 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS original_order_no, 'side' AS side_name,
    substring(o_orderpriority, 1, 1) AS order_type_code, o_orderpriority AS order_type_name,
    lpad(CAST(o_orderkey % 240000 AS VARCHAR), 6, '0') AS order_time, {cents_sql('o_totalprice')} AS order_price,
    {cents_sql('o_totalprice')} AS avg_price, CAST(3 AS BIGINT) AS cancel_confirm_qty,
    CASE WHEN o_orderkey % 4 <> 0 THEN CAST(0 AS BIGINT) END AS rejected_qty, 'none' AS condition_name, 'KRX' AS exchange_id_code,
    CAST(o_orderkey AS VARCHAR) AS order_orgno, 'batch' AS last_source, o_orderdate AS seen_at FROM orders)"""
_NORMAL_COLUMNS = ["account_id", "account_product_code", "account_type", "order_date", "order_branch_no", "order_no", "symbol",
                   "symbol_name", "side_code", "order_qty", "total_order_qty", "filled_qty", "filled_amount", "pending_qty",
                   "is_cancelled", "last_order_history_id", "original_order_no", "side_name", "order_type_code", "order_type_name",
                   "order_time", "order_price", "avg_price", "cancel_confirm_qty", "rejected_qty", "condition_name",
                   "exchange_id_code", "order_orgno", "last_source", "seen_at"]


@query("canonical_order_rows", "A7 J13 J14", ctes(_NORMAL) + "SELECT * FROM normal", dates="order_date", times="seen_at")
def _(t):
    return source.order_rows(responses(t))[0].select(*_NORMAL_COLUMNS)


@query("canonical_order_rows_of_documents", "A7 B12 J14", ctes(_NORMAL) + "SELECT * FROM normal", dates="order_date", times="seen_at")
def _(t):
    """From responses that were parsed when they were stored."""
    stored = materialize(append.documents(responses(t), "payload"), scratch_path(t.spark, "documents"))
    return source.order_rows_of_documents(stored)[0].select(*_NORMAL_COLUMNS)


@query("rejected_order_rows", "A7", f"""
SELECT {account_sql('o_custkey')} AS account_id, concat('o', o_orderkey) AS last_order_history_id, 'none' AS symbol FROM orders""")
def _(t):
    return source.order_rows(responses(t))[1].select("account_id", "last_order_history_id", "symbol")


def calendar(t):
    return dimensions.trading_calendar(t.years(), t.holidays())


_GATED = """asked AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'nyse' ELSE 'krx' END AS market, CAST(o_orderdate AS DATE) AS trade_date,
    o_orderdate + INTERVAL 5 HOUR + to_minutes(o_orderkey % 120) AS now FROM orders),
gated AS (SELECT o_orderkey, asked.market, asked.trade_date, now + INTERVAL 9 HOUR AS now_local,
    CASE WHEN is_open IS NULL THEN 'calendar_missing' WHEN NOT is_open THEN 'market_closed'
         WHEN CAST(now + INTERVAL 9 HOUR AS DATE) = asked.trade_date
              AND now + INTERVAL 9 HOUR < CAST(asked.trade_date AS TIMESTAMP) + INTERVAL 15 HOUR + INTERVAL 35 MINUTE THEN 'before_close_grace_window'
         ELSE 'ready' END AS reason
    FROM asked LEFT JOIN calendar c ON c.market = asked.market AND c.trade_date = asked.trade_date)"""


def _clock():
    return F.col("o_orderdate") + F.make_dt_interval(hours=F.lit(5), mins=(F.col("o_orderkey") % 120).cast("int"))


@query("collection_gate", "G12 D7 J12", ctes(CALENDAR, _GATED) + """
SELECT *, CASE WHEN reason = 'ready' THEN 'collect' ELSE 'skipped' END AS status FROM gated""", dates="trade_date", times="now_local")
def _(t):
    asked = t.read("orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "nyse").otherwise("krx").alias("market"),
        F.col("o_orderdate").cast("date").alias("trade_date"), _clock().alias("now"),
    )
    return gate.collection_gate(asked, calendar(t)).select("o_orderkey", "market", "trade_date", "now_local", "reason", "status")


_KRX_GATED = _GATED.replace("CASE WHEN o_orderkey % 10 = 0 THEN 'nyse' ELSE 'krx' END", "'krx'")
_HOLES = """(year(trade_date) = (SELECT min(year) + 1 FROM years)
             OR year(trade_date) = (SELECT max(year) FROM years) AND month(trade_date) > 6)"""


def _stored_calendar(t, root):
    """The stored calendar with a year missing and its last one cut short in June."""
    full = calendar(t).withColumn("updated_at", before())
    bounds = t.years().agg(F.min("year").alias("lo"), F.max("year").alias("hi")).first()
    year = F.year("trade_date")
    hole = (year == bounds["lo"] + 1) | ((year == bounds["hi"]) & (F.month("trade_date") > 6))
    tables.append(full.filter(~hole), root, "market_calendar")


def _asked(t):
    return t.read("orders").select("o_orderkey", F.lit("krx").alias("market"),
                                   F.col("o_orderdate").cast("date").alias("trade_date"), _clock().alias("now"))


@query("gate_with_incomplete_calendar", "C9 A10 B5 G12", ctes(CALENDAR, _KRX_GATED) + """
SELECT *, CASE WHEN reason = 'ready' THEN 'collect' ELSE 'skipped' END AS status FROM gated""", dates="trade_date", times="now_local")
def _(t):
    """Every order's day is known, though the stored calendar lacks a year and a half: the gaps are filled first."""
    root = scratch_path(t.spark, "tables")
    _stored_calendar(t, root)
    gated = gate.gate_stored(t.spark, root, _asked(t), t.holidays(), now())
    return gated.select("o_orderkey", "market", "trade_date", "now_local", "reason", "status")


@query("completed_calendar", "C9 A10 B5", ctes(CALENDAR) + f"""
SELECT market, trade_date, is_open, note,
       CASE WHEN year(trade_date) IN (SELECT year(trade_date) FROM calendar WHERE {_HOLES})
            THEN TIMESTAMP '2024-02-01 12:00:00' ELSE TIMESTAMP '2020-01-01' END AS updated_at,
       (SELECT count(*) FROM calendar WHERE year(trade_date) IN (SELECT year(trade_date) FROM calendar WHERE {_HOLES})) AS first_run,
       CAST(0 AS BIGINT) AS second_run
FROM calendar""", dates="trade_date", times="updated_at")
def _(t):
    """Only years with a gap are written, once."""
    root = scratch_path(t.spark, "tables")
    _stored_calendar(t, root)
    runs = [gate.complete_calendar(t.spark, root, gate.asked_years(_asked(t)), t.holidays(), now()) for _run in range(2)]
    return tables.read_table(t.spark, root, "market_calendar").select(
        "market", "trade_date", "is_open", "note", "updated_at",
        *[F.lit(run.processed).cast("bigint").alias(name) for run, name in zip(runs, ("first_run", "second_run"), strict=True)])


def collected(t):
    rows = t.read("orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.expr(account_sql("o_custkey")).alias("account_id"),
        F.expr(product_sql("o_custkey")).alias("account_product_code"), F.expr(kind_sql("o_custkey")).alias("account_type"),
        F.when(F.col("o_orderkey") % 10 == 0, "nyse").otherwise("krx").alias("market"),
        F.col("o_orderdate").cast("date").alias("trade_date"), _clock().alias("now"),
        F.when(F.col("o_orderkey") % 7 == 0, "<html>busy</html>").otherwise(_document(F.col("o_orderkey") % 2 == 1)).alias("payload"),
    )
    return orders.collect(rows, calendar(t))


_OUTCOMES = """outcomes AS (SELECT o_orderkey, trade_date, reason,
    CASE WHEN reason <> 'ready' THEN 'skipped' WHEN o_orderkey % 7 = 0 THEN 'error' ELSE 'ok' END AS status FROM gated)"""


@query("order_collection_outcomes", "G17", ctes(CALENDAR, _GATED, _OUTCOMES) + """
SELECT concat('o', o_orderkey) AS id, trade_date, status, reason, CASE WHEN status = 'ok' THEN 3 END AS order_count,
       CASE WHEN status = 'ok' THEN 1 END AS canonical_write_count, CASE WHEN status = 'ok' THEN 'saved' END AS history_status
FROM outcomes""", dates="trade_date")
def _(t):
    return collected(t).outcomes.drop("account_id", "account_product_code")


@query("order_collection_counts", "E10", ctes(CALENDAR, _GATED, _OUTCOMES) + """
SELECT trade_date, count(*) AS count, CAST(count(*) FILTER (status = 'ok') AS BIGINT) AS success_count,
       CAST(count(*) FILTER (status = 'error') AS BIGINT) AS error_count, CAST(count(*) FILTER (status = 'ok') AS BIGINT) AS saved_count,
       CAST(0 AS BIGINT) AS not_saved_count
FROM outcomes WHERE status <> 'skipped' GROUP BY trade_date""", dates="trade_date")
def _(t):
    return export.outcome_counts(collected(t).outcomes.filter("status <> 'skipped'"), ["trade_date"])


@query("order_collection_stored", "G17 B4 B12", ctes(CALENDAR, _GATED, _OUTCOMES, _NORMAL) + """
SELECT normal.order_no, normal.order_date, symbol, filled_amount, 'batch' AS last_source, last_order_history_id
FROM normal JOIN outcomes ON concat('o', o_orderkey) = last_order_history_id WHERE status = 'ok'""", dates="order_date")
def _(t):
    run = collected(t)
    empty = tables.conform(run.orders, DOMESTIC_ORDERS).filter(F.lit(False))
    return merge.upsert_orders(empty, run.orders, now()).select(
        "order_no", "order_date", "symbol", "filled_amount", "last_source", "last_order_history_id")


@query("order_collection_observations", "G17 B12", ctes(CALENDAR, _GATED, _OUTCOMES) + """
SELECT concat('o', o_orderkey) AS id, 'domestic' AS market_type, trade_date AS start_date, trade_date AS end_date FROM outcomes WHERE status = 'ok'""",
       dates="start_date end_date")
def _(t):
    return append.order_observations(collected(t).observations).select("id", "market_type", "start_date", "end_date")


def observations(t):
    """Raw history: one observation per order and day range. Those of customers with status P are not there."""
    rows = responses(t).join(t.read("orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("observation_id"), "o_orderstatus", "o_orderdate"), "observation_id")
    return tables.conform(rows.filter("o_orderstatus <> 'P'").select(
        F.col("observation_id").alias("id"), "account_id", "account_product_code", "account_type", F.lit("domestic").alias("market_type"),
        F.col("o_orderdate").cast("date").alias("start_date"), F.date_add(F.col("o_orderdate").cast("date"), 6).alias("end_date"),
        "fetched_at", F.col("payload").alias("data"),
    ), ORDER_HISTORY)


def requests(t):
    """A week asked for from every order's date on."""
    return t.read("orders").select(
        F.expr(account_sql("o_custkey")).alias("account_id"), F.expr(product_sql("o_custkey")).alias("account_product_code"),
        F.lit("domestic").alias("market_type"), F.col("o_orderdate").cast("date").alias("start_date"),
        F.date_add(F.col("o_orderdate").cast("date"), 6).alias("end_date"),
    ).distinct()


def canonical(t):
    """Orders as stored: those of status F never made it."""
    rows = t.orders().filter("side_code <> 'F'").withColumns({"first_seen_at": before(), "last_seen_at": before()})
    return tables.conform(rows, DOMESTIC_ORDERS)


_ASKED = f"""asked AS (SELECT DISTINCT {account_sql('o_custkey')} AS account_id, {product_sql('o_custkey')} AS account_product_code,
    CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate + INTERVAL 6 DAY AS DATE) AS end_date FROM orders),
found AS (SELECT {account_sql('o_custkey')} AS account_id, {product_sql('o_custkey')} AS account_product_code, CAST(o_orderdate AS DATE) AS start_date,
    CAST(o_orderdate + INTERVAL 6 DAY AS DATE) AS end_date, max(concat('o', o_orderkey)) AS snapshot_id FROM orders
    WHERE o_orderstatus <> 'P' GROUP BY 1, 2, 3, 4),
stored AS (SELECT {account_sql('o_custkey')} AS account_id, {product_sql('o_custkey')} AS account_product_code,
    CAST(o_orderdate AS DATE) AS order_date, CAST(o_orderkey AS VARCHAR) AS order_no FROM orders WHERE o_orderstatus <> 'F')"""


@query("order_history_coverage", "G16 C7", ctes(_ASKED) + """
SELECT asked.*, 'domestic' AS market_type, snapshot_id, CASE WHEN snapshot_id IS NULL THEN 'cache_miss' ELSE 'ok' END AS status
FROM asked LEFT JOIN found USING (account_id, account_product_code, start_date, end_date)""", dates="start_date end_date")
def _(t):
    return orders.serve(requests(t), observations(t), canonical(t))[1].drop("fetched_at")


@query("order_history_rows", "G16", ctes(_ASKED) + """
SELECT found.account_id, start_date, end_date, order_date, order_no FROM found JOIN stored ON stored.account_id = found.account_id
AND stored.account_product_code = found.account_product_code AND order_date BETWEEN start_date AND end_date""",
       dates="start_date end_date order_date")
def _(t):
    return orders.serve(requests(t), observations(t), canonical(t))[0].select(
        "account_id", "start_date", "end_date", "order_date", "order_no")


@query("order_history_one_account", "G16 C14", f"""
SELECT order_no, order_date, symbol FROM (
SELECT CAST(o_orderkey AS VARCHAR) AS order_no, strftime(o_orderdate, '%Y%m%d') AS order_date, concat('s', o_orderkey % 50) AS symbol
FROM orders WHERE o_custkey = 7 AND o_orderstatus <> 'F'
AND CAST(o_orderdate AS DATE) BETWEEN DATE '1990-01-01' AND DATE '1999-12-31') AS o""")
def _(t):
    # Every account's orders of the 1990s were asked for once; account 8 is asked about a decade nobody observed.
    observed = responses(t).select(
        "account_id", "account_product_code", F.lit("domestic").alias("market_type"),
        F.make_date(F.lit(1990), F.lit(1), F.lit(1)).alias("start_date"), F.make_date(F.lit(1999), F.lit(12), F.lit(31)).alias("end_date"))
    known = orders.history(canonical(t), observed, "00000007", "22", "19900101", "19991231")
    unknown = orders.history(canonical(t), observed, "00000008", "29", "20000101", "20091231")
    return known.unionByName(unknown).select("order_no", "order_date", "symbol")


@query("orders_to_replay", "B15 G16", ctes(_ASKED) + """
SELECT account_id, start_date, snapshot_id FROM found WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.account_id = found.account_id
AND s.account_product_code = found.account_product_code AND s.order_date BETWEEN found.start_date AND found.end_date)""", dates="start_date")
def _(t):
    missing = orders.missing_from_canonical(requests(t), observations(t), canonical(t))
    return missing.select("account_id", "start_date", F.col("id").alias("snapshot_id"))


@query("replayed_orders", "B15", ctes(_ASKED) + """,
lost AS (SELECT snapshot_id FROM found WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.account_id = found.account_id
    AND s.account_product_code = found.account_product_code AND s.order_date BETWEEN found.start_date AND found.end_date))
SELECT CAST(o_orderkey AS VARCHAR) AS order_no, CAST(o_orderdate AS DATE) AS order_date,
       CASE WHEN o_orderstatus = 'F' THEN 'order_history_backfill' END AS last_source
FROM orders WHERE o_orderstatus <> 'F' OR concat('o', o_orderkey) IN (SELECT snapshot_id FROM lost)""", dates="order_date")
def _(t):
    return orders.replay(requests(t), observations(t), canonical(t), now()).select("order_no", "order_date", "last_source")
