"""Tables made from what is stored raw: realised profits, fills and market sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.operators import append
from folioframe.plans import fills, profits, sessions
from folioframe.registry.core import ctes, query
from folioframe.registry.standins import CALENDAR, account_sql, cents_sql
from folioframe.registry.streams import arriving, sightings, wait
from folioframe.session import scratch_path
from folioframe.sources import dimensions
from folioframe.streaming import jobs

# Every order is a report: its range begins up to a month before the order's day and ends up to six weeks after it, so
# ranges of an account overlap, lie in one another and touch. It lists trades on the first, middle and last day, one of
# them in two lots, one outside the range and one without a symbol.
_ACCOUNT = account_sql("o_custkey % 200")
_START = "date_add(CAST(o_orderdate AS DATE), -CAST(o_orderkey % 31 AS INT))"
_END = "date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 43 AS INT))"
_FETCHED = "CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey * 7 % 400 AS INT))"
_RANGES = f"""ranges AS (
    SELECT concat('r', o_orderkey) AS id, {_ACCOUNT} AS account_id, CAST(o_orderdate AS DATE) AS middle,
           CAST(o_orderdate - to_days(CAST(o_orderkey % 31 AS INT)) AS DATE) AS start_date,
           CAST(o_orderdate + to_days(CAST(o_orderkey % 43 AS INT)) AS DATE) AS end_date,
           {_FETCHED} AS fetched_at, o_orderkey AS k, {cents_sql('o_totalprice')} AS amount FROM orders),
listed AS (
    SELECT id, account_id, start_date, end_date, fetched_at, trade_date, concat('s', (k + lot) % 3) AS symbol, amount + lot AS profit
    FROM ranges, LATERAL (VALUES (start_date, 0), (middle, 1), (middle, 1), (end_date, 2)) AS l(trade_date, lot))"""


def _reports(t):
    def trade(day, lot):
        return F.struct(
            F.date_format(day, "yyyyMMdd").alias("trad_dt"), F.concat(F.lit("s"), ((F.col("o_orderkey") + lot) % 3).cast("string")).alias("pdno"),
            F.lit("name").alias("prdt_name"), F.lit("1,000").alias("sll_qty"),
            (F.expr(cents_sql("o_totalprice")) + lot).cast("string").alias("rlzt_pfls"))

    first, middle, last = F.expr(_START), F.col("o_orderdate").cast("date"), F.expr(_END)
    nameless = trade(middle, 0).withField("pdno", F.lit(None).cast("string"))
    rows = t.read("orders").select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("id"), F.expr(_ACCOUNT).alias("account_id"),
        F.lit("domestic").alias("market_type"), first.alias("start_date"), last.alias("end_date"),
        (F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") * 7 % 400).cast("int"))).alias("fetched_at"),
        F.to_json(F.struct(F.array(trade(first, 0), trade(middle, 1), trade(middle, 1), trade(last, 2),
                                   trade(F.date_add(last, 1), 0), nameless).alias("output1"))).alias("data"))
    return append.profit_reports(rows)


@query("trade_profit_normalized", "M B11", ctes(_RANGES) + """,
days AS (SELECT DISTINCT account_id, trade_date FROM listed),
told AS (SELECT days.account_id, trade_date, arg_max(ranges.id, (fetched_at, ranges.id)) AS id
         FROM days JOIN ranges ON ranges.account_id = days.account_id AND trade_date BETWEEN start_date AND end_date GROUP BY ALL)
SELECT l.account_id, 'domestic' AS market_type, l.trade_date, l.symbol, l.id AS report_id, l.fetched_at, 'name' AS symbol_name,
       CAST(sum(1000) AS DOUBLE) AS sell_qty, CAST(sum(profit) AS DOUBLE) AS profit_amt, count(*) AS lots
FROM listed l JOIN told USING (account_id, trade_date, id) GROUP BY ALL""", dates="trade_date", times="fetched_at")
def _(t):
    return profits.trade_profits(_reports(t)).drop("buy_qty", "buy_amt", "sell_amt", "fee_amt", "tax_amt")


@query("trade_profit_rejects", "M B11", ctes(_RANGES) + """
SELECT id, account_id, CAST(end_date + 1 AS DATE) AS trade_date, concat('s', k % 3) AS symbol FROM ranges
UNION ALL SELECT id, account_id, middle, NULL FROM ranges""", dates="trade_date")
def _(t):
    return profits.report_rows(_reports(t)).rejects.select("id", "account_id", "trade_date", "symbol")


_FILLS = f"""seen AS (
    SELECT {account_sql('user_id')} AS account_id, CAST(ts AS DATE) AS order_date, event_type AS order_no, ts AS seen_at,
           event_id AS place, event_id % 50 AS filled_qty, {cents_sql('value')} AS filled_amount, event_id % 17 = 0 AS is_cancelled
    FROM events),
moved AS (
    SELECT *, filled_qty - coalesce(lag(filled_qty) OVER o, 0) AS qty, filled_amount - coalesce(lag(filled_amount) OVER o, 0) AS amount,
           is_cancelled AND NOT coalesce(lag(is_cancelled) OVER o, false) AS cancelled, lag(seen_at) OVER o AS previous_seen_at
    FROM seen WINDOW o AS (PARTITION BY account_id, order_date, order_no ORDER BY seen_at, place)),
events_of AS (
    SELECT account_id, order_date, order_no, seen_at, place, previous_seen_at, qty AS filled_qty, amount AS filled_amount, cancelled,
           CASE WHEN qty > 0 THEN 'fill' WHEN qty < 0 OR amount <> 0 THEN 'correction' WHEN cancelled THEN 'cancel' END AS kind,
           CASE WHEN qty > 0 AND amount > 0 THEN CAST(amount AS DOUBLE) / qty END AS price FROM moved)"""
_FILL_COLUMNS = ["account_id", "order_date", "order_no", "seen_at", "place", "previous_seen_at", "filled_qty", "filled_amount",
                 "cancelled", "kind", "price"]


def _seen(events):
    return sightings(events).withColumns({
        "filled_qty": F.col("place") % 50, "is_cancelled": F.col("place") % 17 == 0})


@query("order_fills", "M B4", ctes(_FILLS) + "SELECT * FROM events_of WHERE kind IS NOT NULL", dates="order_date",
       times="seen_at previous_seen_at")
def _(t):
    """Every sighting twice; a task holds a twelfth of the rows, so orders are cut over tasks."""
    seen = _seen(t.read("events"))
    return fills.fills(fills.sightings(seen.unionByName(seen)), tasks=12).select(*_FILL_COLUMNS)


@query("stream_order_fills", "M K2", ctes(_FILLS) + "SELECT * FROM events_of WHERE kind IS NOT NULL", dates="order_date",
       times="seen_at previous_seen_at")
def _(t):
    """The latest sightings come in the first batch."""
    out, state = scratch_path(t.spark, "sightings"), scratch_path(t.spark, "sightings-state")
    wait(jobs.write_partials(_seen(arriving(t)), fills.sightings, out, state))
    return fills.fills(jobs.read_partials(t.spark, out, fills.sightings)).select(*_FILL_COLUMNS)


@query("fills_add_up_to_the_order", "M B4", f"""
SELECT {account_sql('user_id')} AS account_id, CAST(ts AS DATE) AS order_date, event_type AS order_no,
       CAST(arg_max(event_id % 50, (ts, event_id)) AS BIGINT) AS filled_qty, arg_max({cents_sql('value')}, (ts, event_id)) AS filled_amount
FROM events GROUP BY user_id, CAST(ts AS DATE), event_type HAVING count(*) > 1 OR max(event_id % 50) > 0 OR max(event_id % 17) = 0
   OR max({cents_sql('value')}) <> 0""", dates="order_date")
def _(t):
    events = fills.fills(fills.sightings(_seen(t.read("events"))))
    return events.groupBy("account_id", "order_date", "order_no").agg(
        F.sum("filled_qty").alias("filled_qty"), F.sum("filled_amount").alias("filled_amount"))


# Two markets whose calendars are made from the orders' years: one in Seoul, one in New York, whose days before a
# closed day are half days and whose clock changes twice a year.
_SESSIONS = """hours AS (
    SELECT 'krx' AS market, trade_date, time '09:00' AS opens, time '15:30' AS closes, 'Asia/Seoul' AS zone FROM calendar WHERE is_open
    UNION ALL
    SELECT 'nyse', c.trade_date, time '09:30', CASE WHEN n.is_open THEN time '16:00' ELSE time '13:00' END, 'America/New_York'
    FROM calendar c LEFT JOIN calendar n ON n.trade_date = c.trade_date + 1 WHERE c.is_open),
sessions AS (
    SELECT market, trade_date, timezone('UTC', timezone(zone, trade_date + opens)) AS open_at,
           timezone('UTC', timezone(zone, trade_date + closes)) AS close_at FROM hours)"""


def two_calendars(t):
    days = dimensions.trading_calendar(t.years(), t.holidays())
    following = days.select(F.date_sub("trade_date", 1).alias("trade_date"), F.col("is_open").alias("_next_open"))
    york = days.join(following, "trade_date", "left").withColumns({
        "market": F.lit("nyse"), "timezone": F.lit("America/New_York"), "open_time_local": F.lit("09:30"),
        "close_time_local": F.when(F.coalesce("_next_open", F.lit(False)), "16:00").otherwise("13:00")}).drop("_next_open")
    return days.unionByName(york)


@query("market_session_calendar", "M A10", ctes(CALENDAR, _SESSIONS) + """
SELECT *, date_diff('minute', open_at, close_at) AS minutes FROM sessions""", dates="trade_date", times="open_at close_at")
def _(t):
    return sessions.market_sessions(two_calendars(t))


@query("events_by_market_session", "M D7", ctes(CALENDAR, _SESSIONS) + """,
told AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'nyse' ELSE 'krx' END AS market,
                o_orderdate + to_seconds(o_orderkey * 677 % 86400) AS event_at FROM orders)
SELECT o_orderkey, told.market, event_at, trade_date AS session_date, CAST(floor(epoch(event_at - open_at) / 60) AS BIGINT) AS minutes_from_open,
       CAST(floor(epoch(close_at - event_at) / 60) AS BIGINT) AS minutes_to_close
FROM told LEFT JOIN sessions s ON s.market = told.market AND event_at >= open_at AND event_at < close_at""", dates="session_date", times="event_at")
def _(t):
    told = t.read("orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "nyse").otherwise("krx").alias("market"),
        (F.col("o_orderdate") + F.make_dt_interval(secs=(F.col("o_orderkey") * 677 % 86400))).alias("event_at"))
    return sessions.tag_sessions(told, sessions.market_sessions(two_calendars(t)), time="event_at")
