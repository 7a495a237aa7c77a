"""Keyed merges and append-only writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.functions.text import parse_day
from folioframe.operators import append, export, merge, tables
from folioframe.registry.core import ctes, query
from folioframe.registry.standins import (
    CALENDAR,
    MASTER,
    ORDERS,
    OVERVIEWS,
    PRICES,
    RATES,
    SNAPS,
    account_sql,
    cents_sql,
    kind_sql,
    product_sql,
    symbol_sql,
)
from folioframe.schemas import (
    DOMESTIC_ORDERS,
    EXCHANGE_RATE_HISTORY,
    INSTRUMENT_MASTER,
    MARKET_CALENDAR,
    PORTFOLIO_SNAPSHOTS,
    PRICE_HISTORY,
)
from folioframe.session import scratch_path
from folioframe.sources import dimensions

_MIDDLE = "2024-01-15"


def before():
    """When stored rows were written."""
    return F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")


def now():
    return F.lit("2024-02-01 12:00:00").cast("timestamp_ntz")


def stored_prices(t):
    """Prices of the first half of the month, as stored before."""
    early = t.prices().filter(F.col("date") < F.lit(_MIDDLE).cast("date"))
    return tables.conform(early.withColumns({"adjusted": F.lit(False), "created_at": before()}), PRICE_HISTORY)


def quotes(t):
    """One price row per event: many per key, ordered by `seq`."""
    cents = F.expr(cents_sql("value")).cast("double")
    return t.read("events").select(
        F.expr(symbol_sql("user_id")).alias("symbol"),
        F.when(F.col("user_id") % 3 == 0, "NAS").otherwise("KRX").alias("exchange"),
        F.col("ts").cast("date").alias("date"), cents.alias("open"), cents.alias("high"), cents.alias("low"),
        cents.alias("close"), F.col("event_id").alias("volume"), F.col("event_id").alias("seq"),
    )


_QUOTES = f"""quotes AS (SELECT {symbol_sql('user_id')} AS symbol, CASE WHEN user_id % 3 = 0 THEN 'NAS' ELSE 'KRX' END AS exchange,
    CAST(ts AS DATE) AS date, CAST({cents_sql('value')} AS DOUBLE) AS c, event_id FROM events),
stored AS (SELECT * FROM prices WHERE date < DATE '{_MIDDLE}')"""


@query("insert_absent_prices", "B1 D8", ctes(PRICES, _QUOTES) + """
SELECT symbol, exchange, date, arg_min(c, event_id) AS open, arg_min(c, event_id) AS high, arg_min(c, event_id) AS low,
       arg_min(c, event_id) AS close, min(event_id) AS volume, false AS adjusted
FROM quotes q WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.symbol = q.symbol AND s.exchange = q.exchange AND s.date = q.date)
GROUP BY symbol, exchange, date""", dates="date")
def _(t):
    return merge.insert_prices(stored_prices(t), quotes(t), now(), ["seq"]).drop("created_at")


@query("overwrite_adjusted_prices", "B2", ctes(PRICES, _QUOTES) + """,
newest AS (SELECT symbol, exchange, date, arg_max(c, event_id) AS c, max(event_id) AS v FROM quotes
           GROUP BY symbol, exchange, date)
SELECT coalesce(n.symbol, s.symbol) AS symbol, coalesce(n.exchange, s.exchange) AS exchange, coalesce(n.date, s.date) AS date,
       coalesce(n.c, s.open) AS open, coalesce(n.c, s.high) AS high, coalesce(n.c, s.low) AS low, coalesce(n.c, s.close) AS close,
       coalesce(n.v, s.volume) AS volume, n.symbol IS NOT NULL AS adjusted,
       CASE WHEN s.symbol IS NULL THEN TIMESTAMP '2024-02-01 12:00:00' ELSE TIMESTAMP '2020-01-01' END AS created_at
FROM stored s FULL JOIN newest n ON s.symbol = n.symbol AND s.exchange = n.exchange AND s.date = n.date""",
       dates="date", times="created_at")
def _(t):
    return merge.overwrite_adjusted(stored_prices(t), quotes(t), now(), ["seq"])


@query("insert_absent_rates", "B3 D8", ctes(RATES) + f"""
SELECT upper(currency) AS currency, date, period, arg_min(rate, seq) AS rate FROM rates r
WHERE NOT EXISTS (SELECT 1 FROM rates s WHERE upper(s.currency) = upper(r.currency) AND s.date = r.date AND s.period = r.period
                  AND s.date < DATE '{_MIDDLE}' AND s.period = 'D')
GROUP BY upper(currency), date, period""", dates="date")
def _(t):
    early = t.rates().withColumn("currency", F.upper("currency")).filter(
        (F.col("date") < F.lit(_MIDDLE).cast("date")) & (F.col("period") == "D"))
    stored = tables.conform(merge.one_per_key(early, ("currency", "date", "period"), ["seq"]), EXCHANGE_RATE_HISTORY)
    return merge.insert_rates(stored, t.rates(), now(), ["seq"]).drop("created_at")


def order_sightings(t):
    """Each order observed twice in one batch, the second time changed and with some values gone."""
    first = t.orders().withColumns({"seen_at": F.col("o_orderdate"), "place": F.lit(0)})
    second = first.withColumns({
        "place": F.lit(1), "filled_amount": F.col("filled_amount") + 1, "last_source": F.lit("batch"),
        "order_time": F.when(F.col("o_orderkey") % 2 == 0, F.col("order_time")),
    })
    return first.withColumn("last_source", F.lit("first")).unionByName(second)


def stored_orders(t):
    """Orders with status F as stored long ago."""
    old = t.orders().filter("side_code = 'F'").withColumns({
        "first_seen_at": before(), "last_seen_at": before(), "filled_amount": F.lit(0), "last_source": F.lit("stored"),
    })
    return tables.conform(old, DOMESTIC_ORDERS)


_SHOWN = ["account_id", "account_product_code", "order_date", "order_branch_no", "order_no", "symbol", "side_code",
          "order_time", "filled_amount", "last_source", "first_seen_at", "last_seen_at"]


@query("upsert_orders", "B4", ctes(ORDERS) + """
SELECT account_id, account_product_code, order_date, order_branch_no, order_no, symbol, side_code,
       CASE WHEN CAST(order_no AS BIGINT) % 2 = 0 THEN order_time END AS order_time, filled_amount + 1 AS filled_amount,
       'batch' AS last_source,
       CASE WHEN side_code = 'F' THEN TIMESTAMP '2020-01-01' ELSE TIMESTAMP '2024-02-01 12:00:00' END AS first_seen_at,
       TIMESTAMP '2024-02-01 12:00:00' AS last_seen_at FROM seen""", dates="order_date", times="first_seen_at last_seen_at")
def _(t):
    return merge.upsert_orders(stored_orders(t), order_sightings(t), now()).select(*_SHOWN)


@query("upsert_orders_kept_rows", "B4", ctes(ORDERS) + """
SELECT order_no, CASE WHEN side_code = 'F' THEN 'stored' ELSE 'changed' END AS last_source,
       side_code <> 'F' AS written FROM seen""")
def _(t):
    changed = t.orders().filter("side_code <> 'F'").withColumns({
        "last_source": F.lit("changed"), "seen_at": F.col("o_orderdate"), "place": F.lit(0)})
    merged = merge.upsert_orders(stored_orders(t), changed, now())
    return merged.select("order_no", "last_source", (F.col("last_seen_at") == now()).alias("written"))


@query("upsert_orders_by_user_day", "B4", f"""
SELECT {account_sql('user_id')} AS account_id, CAST(ts AS DATE) AS order_date, event_type AS order_no,
       arg_max({cents_sql('value')}, (ts, event_id)) AS filled_amount FROM events
GROUP BY user_id, CAST(ts AS DATE), event_type""", dates="order_date")
def _(t):
    seen = t.read("events").select(
        F.expr(account_sql("user_id")).alias("account_id"), F.lit("01").alias("account_product_code"),
        F.lit("brokerage").alias("account_type"), F.col("ts").cast("date").alias("order_date"),
        F.lit("").alias("order_branch_no"), F.col("event_type").alias("order_no"),
        F.expr(cents_sql("value")).alias("filled_amount"), F.col("ts").alias("seen_at"), F.col("event_id").alias("place"),
    )
    empty = tables.conform(seen, DOMESTIC_ORDERS).filter(F.lit(False))
    return merge.upsert_orders(empty, seen, now()).select("account_id", "order_date", "order_no", "filled_amount")


@query("upsert_calendar", "B5", ctes(CALENDAR) + """
SELECT market, trade_date, is_open, note,
       CASE WHEN isodow(trade_date) = 1 THEN TIMESTAMP '2024-02-01 12:00:00' ELSE TIMESTAMP '2020-01-01' END AS updated_at
FROM (SELECT market, trade_date, CASE WHEN isodow(trade_date) = 1 THEN false ELSE is_open END AS is_open,
             CASE WHEN isodow(trade_date) = 1 THEN NULL ELSE note END AS note FROM calendar) AS c""",
       dates="trade_date", times="updated_at")
def _(t):
    full = dimensions.trading_calendar(t.years(), t.holidays())
    stored = tables.conform(full.withColumn("updated_at", before()), MARKET_CALENDAR)
    mondays = full.filter(F.weekday("trade_date") == 0).withColumns({
        "is_open": F.lit(False), "note": F.lit(None).cast("string"), "seq": F.lit(1)})
    return merge.upsert_calendar(stored, mondays, now(), ["seq"]).select("market", "trade_date", "is_open", "note", "updated_at")


@query("upsert_master", "B6", ctes(MASTER) + """
SELECT symbol, market, concat('second ', name) AS name, CASE WHEN etp_code = '' THEN NULL ELSE etp_code END AS etp_code,
       group_code, TIMESTAMP '2024-02-01 12:00:00' AS updated_at FROM master WHERE idx_mid_code <> 'Brand#1'
UNION ALL SELECT symbol, market, name, etp_code, 'old', TIMESTAMP '2020-01-01' FROM master WHERE idx_mid_code = 'Brand#1'""",
       times="updated_at")
def _(t):
    stored = tables.conform(t.master().withColumns({"updated_at": before(), "group_code": F.lit("old")}), INSTRUMENT_MASTER)
    new = t.master().filter("idx_mid_code <> 'Brand#1'").withColumns({
        "etp_code": F.nullif("etp_code", F.lit("")), "raw_data": F.lit(None).cast("string")})
    first = new.withColumns({"name": F.concat(F.lit("first "), "name"), "listing": F.lit(0)})
    second = new.withColumns({"name": F.concat(F.lit("second "), "name"), "listing": F.lit(1)})
    merged = merge.upsert_master(stored, first.unionByName(second), now(), ["listing"])
    return merged.select("symbol", "market", "name", "etp_code", "group_code", "updated_at")


def _stored_again(t, rows, name):
    """Append in two writes, then read the table back."""
    root = scratch_path(t.spark, "tables")
    tables.append(rows, root, name)
    tables.append(rows.limit(0), root, name)
    return tables.read_table(t.spark, root, name)


@query("append_portfolio_snapshots", "B7", ctes(SNAPS) + """
SELECT account_id, account_type, snapshot_at, total_eval_amt, balance_data, strftime(snapshot_at, '%Y-%m') AS month FROM snaps""",
       times="snapshot_at")
def _(t):
    rows = append.portfolio_snapshots(t.snapshots().drop("id"))
    return _stored_again(t, rows, "portfolio_snapshots").drop("id")


@query("append_overseas_snapshots", "B8 J16", f"""
SELECT {account_sql('user_id')} AS account_id, event_type AS account_type, ts AS snapshot_at, {cents_sql('value')} AS stock_eval_amt_krw,
       event_id AS cash_amt_krw, {cents_sql('value')} + event_id AS total_asset_amt_krw,
       concat('{{"USD":', event_id, '}}') AS fx_data, props AS balance_data, CAST(NULL AS VARCHAR) AS deposit_data FROM events""",
       times="snapshot_at")
def _(t):
    stock = F.expr(cents_sql("value"))
    rows = t.read("events").select(
        F.expr(account_sql("user_id")).alias("account_id"), F.col("event_type").alias("account_type"),
        F.col("ts").alias("snapshot_at"), stock.alias("stock_eval_amt_krw"), F.col("event_id").alias("cash_amt_krw"),
        (stock + F.col("event_id")).alias("total_asset_amt_krw"), F.struct(F.col("event_id").alias("USD")).alias("fx_data"),
        F.col("props").alias("balance_data"),
    )
    return _stored_again(t, append.overseas_snapshots(rows), "overseas_asset_snapshots").drop("id", "month")


@query("append_overview_snapshots", "B9", ctes(OVERVIEWS) + """
SELECT snapshot_at, base_currency, total_eval_amt_krw, domestic_pct, cash_amt_krw,
       json_extract_string(concat('{"p":', coalesce(CAST(overseas_pct AS VARCHAR), 'null'), '}'), '$.p') AS overseas_pct_in_json
FROM overviews""", times="snapshot_at")
def _(t):
    stored = _stored_again(t, append.overview_snapshots(t.overviews().drop("id")), "asset_overview_snapshots")
    return stored.select(
        "snapshot_at", "base_currency", "total_eval_amt_krw", "domestic_pct", "cash_amt_krw",
        F.get_json_object("allocation_data", "$.overseas_pct").alias("overseas_pct_in_json"),
    )


@query("append_holding_snapshots", "B10", f"""
SELECT CAST(l_orderkey AS VARCHAR) AS overview_snapshot_id, CAST(l_partkey AS VARCHAR) AS symbol, l_shipdate AS snapshot_at,
       l_quantity AS quantity, {cents_sql('l_extendedprice')} AS value_krw, CAST(NULL AS VARCHAR) AS raw_data FROM lineitem""",
       times="snapshot_at")
def _(t):
    rows = t.read("lineitem").select(
        F.col("l_orderkey").cast("string").alias("overview_snapshot_id"), F.col("l_partkey").cast("string").alias("symbol"),
        F.col("l_shipdate").alias("snapshot_at"), F.col("l_quantity").alias("quantity"),
        F.expr(cents_sql("l_extendedprice")).alias("value_krw"),
    )
    stored = _stored_again(t, append.holding_snapshots(rows), "asset_holding_snapshots")
    return stored.select("overview_snapshot_id", "symbol", "snapshot_at", "quantity", "value_krw", "raw_data")


_REPORT = "{a} AS account_id, 'domestic' AS market_type, CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) AS end_date, o_orderdate AS fetched_at, o_orderpriority AS data"


def _reports(t):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    return t.read("orders").select(
        F.expr(account_sql("o_custkey")).alias("account_id"), F.expr(kind_sql("o_custkey")).alias("account_type"),
        F.expr(product_sql("o_custkey")).alias("account_product_code"), F.lit("domestic").alias("market_type"),
        day.alias("start_date"), day.alias("end_date"), F.col("o_orderdate").alias("fetched_at"),
        F.col("o_orderpriority").alias("data"),
    )


@query("append_profit_reports", "B11", f"SELECT {_REPORT.format(a=account_sql('o_custkey'))} FROM orders",
       dates="start_date end_date", times="fetched_at")
def _(t):
    return _stored_again(t, append.profit_reports(_reports(t)), "trade_profit_history").drop("id", "month")


@query("append_order_observations", "B12", f"""
SELECT {_REPORT.format(a=account_sql('o_custkey'))}, {kind_sql('o_custkey')} AS account_type,
       {product_sql('o_custkey')} AS account_product_code FROM orders""", dates="start_date end_date", times="fetched_at")
def _(t):
    return _stored_again(t, append.order_observations(_reports(t)), "order_history").drop("id", "month")


@query("appended_row_ids_are_unique", "B7", "SELECT count(*) AS rows, count(*) AS ids FROM events")
def _(t):
    rows = append.portfolio_snapshots(t.snapshots().drop("id"))
    stored = _stored_again(t, rows, "portfolio_snapshots")
    return stored.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"))


@query("conformed_columns", "B14", """
SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS account_id, CAST(NULL AS VARCHAR) AS account_type, ts AS snapshot_at,
       user_id AS total_eval_amt, CAST(NULL AS VARCHAR) AS balance_data FROM events""", times="snapshot_at")
def _(t):
    narrow = t.read("events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("account_id"), F.col("ts").alias("snapshot_at"),
        F.col("user_id").cast("int").alias("total_eval_amt"), F.col("props").alias("unknown_column"),
    )
    return tables.conform(narrow, PORTFOLIO_SNAPSHOTS)


@query("stored_order_merge", "B4 B14", ctes(ORDERS) + """
SELECT account_id, account_product_code, order_date, order_branch_no, order_no, symbol, side_code,
       CASE WHEN CAST(order_no AS BIGINT) % 2 = 0 THEN order_time END AS order_time, filled_amount + 1 AS filled_amount, 'batch' AS last_source
FROM seen""", dates="order_date")
def _(t):
    """The merge against a stored table: only the months of the new observations are rewritten."""
    root = scratch_path(t.spark, "tables")
    tables.append(stored_orders(t), root, "domestic_orders")
    tables.rewrite(t.spark, root, "domestic_orders", order_sightings(t),
                   lambda target, new: merge.upsert_orders(target, new, now()))
    return tables.read_table(t.spark, root, "domestic_orders").select(*_SHOWN[:-2])


@query("stored_price_insert", "B1 D8", ctes(PRICES, _QUOTES) + f"""
SELECT symbol, exchange, date, close, TIMESTAMP '2020-01-01' AS created_at FROM stored
UNION ALL
SELECT symbol, exchange, date, arg_min(c, event_id), TIMESTAMP '2024-02-01 12:00:00' FROM quotes q
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.symbol = q.symbol AND s.exchange = q.exchange AND s.date = q.date)
GROUP BY symbol, exchange, date""", dates="date", times="created_at")
def _(t):
    """Insert if absent against a stored table, twice; the second run finds nothing new."""
    root = scratch_path(t.spark, "tables")
    tables.append(stored_prices(t), root, "price_history")
    for _run in range(2):
        tables.insert(t.spark, root, "price_history", quotes(t), lambda target, new: merge.insert_prices(target, new, now(), ["seq"]))
    return tables.read_table(t.spark, root, "price_history").select("symbol", "exchange", "date", "close", "created_at")


_BROKEN = "CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE {day} END"


@query("stored_price_insert_bad_dates", "B1 B2 J11", ctes(PRICES, _QUOTES) + f"""
SELECT symbol, exchange, date, arg_max(c, event_id) AS close, true AS adjusted,
       (SELECT count(*) FROM events WHERE event_id % 11 = 0) AS rejected
FROM quotes JOIN (SELECT event_id FROM events WHERE event_id % 11 <> 0) USING (event_id)
GROUP BY symbol, exchange, date""", dates="date")
def _(t):
    """Days that do not parse are rejects of every merge: counted, never stored, and not stored again by a second run."""
    root = scratch_path(t.spark, "tables")
    tables.create(t.spark, root, "price_history")
    day = F.expr(_BROKEN.format(day="date_format(date, 'yyyyMMdd')").replace("event_id", "seq"))
    given = quotes(t).withColumn("date", parse_day(day))
    for _run in range(2):
        tables.insert(t.spark, root, "price_history", given, lambda target, new: merge.insert_prices(target, new, now(), ["seq"]))
        counts = tables.rewrite(t.spark, root, "price_history", given,
                                lambda target, new: merge.overwrite_adjusted(target, new, now(), ["seq"]))
    return tables.read_table(t.spark, root, "price_history").select(
        "symbol", "exchange", "date", "close", "adjusted", F.lit(counts.rejected).cast("bigint").alias("rejected"))


@query("stored_calendar_merge", "B5", ctes(CALENDAR) + """
SELECT market, trade_date, is_open, note,
       CASE WHEN isodow(trade_date) = 1 THEN TIMESTAMP '2024-02-01 12:00:00' ELSE TIMESTAMP '2020-01-01' END AS updated_at,
       (SELECT count(*) FROM calendar WHERE isodow(trade_date) = 1) AS processed
FROM (SELECT market, trade_date, CASE WHEN isodow(trade_date) = 1 THEN false ELSE is_open END AS is_open,
             CASE WHEN isodow(trade_date) = 1 THEN NULL ELSE note END AS note FROM calendar) AS c""",
       dates="trade_date", times="updated_at")
def _(t):
    """The calendar stored by year; a merge under a batch name, and the same batch again."""
    root = scratch_path(t.spark, "tables")
    full = dimensions.trading_calendar(t.years(), t.holidays())
    tables.append(full.withColumn("updated_at", before()), root, "market_calendar")
    mondays = full.filter(F.weekday("trade_date") == 0).withColumns({
        "is_open": F.lit(False), "note": F.lit(None).cast("string"), "seq": F.lit(1)})
    for _run in range(2):
        counts = tables.rewrite(t.spark, root, "market_calendar", mondays,
                                lambda target, new: merge.upsert_calendar(target, new, now(), ["seq"]),
                                batch="mondays")
    return tables.read_table(t.spark, root, "market_calendar").select(
        "market", "trade_date", "is_open", "note", "updated_at", F.lit(counts.processed).cast("bigint").alias("processed"))


@query("stored_master_merge", "B6", ctes(MASTER) + """
SELECT symbol, CASE WHEN idx_mid_code = 'Brand#11' THEN 'NYS' ELSE market END AS market, concat('second ', name) AS name,
       TIMESTAMP '2024-02-01 12:00:00' AS updated_at FROM master WHERE idx_mid_code <> 'Brand#1'
UNION ALL SELECT symbol, market, name, TIMESTAMP '2020-01-01' FROM master WHERE idx_mid_code IN ('Brand#1', 'Brand#11')""",
       times="updated_at")
def _(t):
    """The master stored by market: only the markets of the new rows are rewritten."""
    root = scratch_path(t.spark, "tables")
    tables.append(t.master().withColumn("updated_at", before()), root, "instrument_master")
    new = t.master().filter("idx_mid_code <> 'Brand#1'").withColumn(
        "market", F.when(F.col("idx_mid_code") == "Brand#11", "NYS").otherwise(F.col("market")))
    first = new.withColumns({"name": F.concat(F.lit("first "), "name"), "listing": F.lit(0)})
    second = new.withColumns({"name": F.concat(F.lit("second "), "name"), "listing": F.lit(1)})
    tables.rewrite(t.spark, root, "instrument_master", first.unionByName(second),
                   lambda target, rows: merge.upsert_master(target, rows, now(), ["listing"]))
    return tables.read_table(t.spark, root, "instrument_master").select("symbol", "market", "name", "updated_at")


_CHANGED = "order_no = (SELECT min(order_no) FROM seen) OR order_no = (SELECT max(order_no) FROM seen)"


@query("export_of_changed_parts", "B13 A12", ctes(ORDERS) + f"""
SELECT 'domestic_orders' AS "table", strftime(order_date, '%Y-%m') AS part, count(*) AS rows,
       CASE WHEN bool_or({_CHANGED}) THEN 'exported' ELSE 'unchanged' END AS status, CAST(0 AS BIGINT) AS broken
FROM seen GROUP BY 2""")
def _(t):
    """All orders exported, two of them changed in the stored table, and the export brought up to date."""
    root, out = scratch_path(t.spark, "tables"), scratch_path(t.spark, "export")
    rows = t.orders().withColumns({"seen_at": F.col("o_orderdate"), "place": F.lit(0)})
    tables.append(tables.conform(rows.withColumns({"first_seen_at": before(), "last_seen_at": before()}), DOMESTIC_ORDERS),
                  root, "domestic_orders")
    export.export_changed(t.spark, root, ["domestic_orders"], out)
    ends = t.orders().agg(F.min("order_no").alias("lo"), F.max("order_no").alias("hi")).first()
    changed = rows.filter(F.col("order_no").isin(ends["lo"], ends["hi"])).withColumn("filled_amount", F.col("filled_amount") + 1)
    tables.rewrite(t.spark, root, "domestic_orders", changed, lambda target, new: merge.upsert_orders(target, new, now()))
    told = export.export_changed(t.spark, root, ["domestic_orders"], out)
    return told.withColumn("broken", F.lit(export.broken_parts(t.spark, out, ["domestic_orders"]).count()).cast("bigint"))


@query("late_observations_keep_the_newest", "B4 K2", f"""
SELECT {account_sql('user_id')} AS account_id, CAST(ts AS DATE) AS order_date, event_type AS order_no,
       arg_max({cents_sql('value')}, (ts, event_id)) AS filled_amount FROM events
GROUP BY user_id, CAST(ts AS DATE), event_type""", dates="order_date")
def _(t):
    """Two merges, the later half of each day's observations in the first."""
    seen = t.read("events").select(
        F.expr(account_sql("user_id")).alias("account_id"), F.lit("01").alias("account_product_code"),
        F.lit("brokerage").alias("account_type"), F.col("ts").cast("date").alias("order_date"),
        F.lit("").alias("order_branch_no"), F.col("event_type").alias("order_no"),
        F.expr(cents_sql("value")).alias("filled_amount"), F.col("ts").alias("seen_at"), F.col("event_id").alias("place"),
    )
    target = tables.conform(seen, DOMESTIC_ORDERS).filter(F.lit(False))
    late = F.hour("seen_at") >= 12
    for batch in (seen.filter(late), seen.filter(~late)):
        target = merge.upsert_orders(target, batch, now())
    return target.select("account_id", "order_date", "order_no", "filled_amount")
