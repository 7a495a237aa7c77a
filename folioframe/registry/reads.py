"""Range reads, lookups and coverage checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioframe.operators import merge, reads
from folioframe.operators.tables import conform
from folioframe.registry.core import ctes, query
from folioframe.registry.standins import (
    CALENDAR,
    MASTER,
    ORDERS,
    OVERRIDES,
    OVERVIEWS,
    PRICES,
    RATES,
    SNAPS,
    symbol_sql,
)
from folioframe.schemas import DOMESTIC_ORDERS
from folioframe.sources import dimensions
from folioframe.sources.orders import display_rows


@query("price_range", "C1", ctes(PRICES) + """
SELECT * FROM prices WHERE symbol = '000007' AND exchange = 'KRX' AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
       dates="date")
def _(t):
    return reads.prices(t.prices(), "000007", "KRX", "20240105", "2024-01-20")


_ASKED = f"""asked AS (SELECT DISTINCT {symbol_sql('user_id')} AS symbol,
    CASE WHEN event_id % 2 = 0 THEN 'KRX' ELSE 'NAS' END AS exchange, CAST(ts AS DATE) AS start_date,
    CAST(ts + INTERVAL 2 DAY AS DATE) AS end_date FROM events)"""


@query("price_coverage", "C2", ctes(PRICES, _ASKED) + """
SELECT *, EXISTS (SELECT 1 FROM prices p WHERE p.symbol = asked.symbol AND p.exchange = asked.exchange
                  AND p.date BETWEEN asked.start_date AND asked.end_date) AS covered FROM asked""",
       dates="start_date end_date")
def _(t):
    asked = t.read("events").select(
        F.expr(symbol_sql("user_id")).alias("symbol"),
        F.when(F.col("event_id") % 2 == 0, "KRX").otherwise("NAS").alias("exchange"),
        F.col("ts").cast("date").alias("start_date"), F.date_add(F.col("ts").cast("date"), 2).alias("end_date"),
    ).distinct()
    return reads.has_prices(t.prices(), asked)


@query("rate_range", "C3", ctes(RATES) + """
SELECT upper(currency) AS currency, date, period, arg_min(rate, seq) AS rate FROM rates
WHERE upper(currency) = 'C7' AND period = 'D' AND date BETWEEN DATE '2000-01-01' AND DATE '2024-01-25'
GROUP BY upper(currency), date, period""", dates="date")
def _(t):
    stored = merge.one_per_key(t.rates().withColumn("currency", F.upper("currency")), ("currency", "date", "period"),
                               ["seq"], keep="first")
    return reads.rates(stored, "c7", end="20240125").drop("seq")


@query("snapshot_range", "C4", ctes(SNAPS) + """
SELECT * FROM snaps WHERE account_id = '00000007' AND snapshot_at >= TIMESTAMP '2024-01-03'
AND snapshot_at < TIMESTAMP '2024-01-21'""", times="snapshot_at")
def _(t):
    return reads.portfolio_snapshots(t.snapshots(), "00000007", "20240103", "2024-01-20")


@query("overview_range", "C5", ctes(OVERVIEWS) + """
SELECT * FROM overviews WHERE snapshot_at >= TIMESTAMP '2024-01-03' AND snapshot_at < TIMESTAMP '2024-01-21'""", times="snapshot_at")
def _(t):
    return reads.overview_snapshots(t.overviews(), "2024-01-03", "20240120")


@query("order_range", "C6 H3", ctes(ORDERS) + """
SELECT CAST(row_number() OVER (ORDER BY order_date DESC, order_time DESC NULLS LAST, order_no DESC) AS INTEGER) AS place, seen.*
FROM seen WHERE account_id = '00000007' AND account_product_code = '22'
AND order_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""", dates="order_date")
def _(t):
    rows = reads.orders(t.orders().drop("o_orderkey", "o_orderdate"), "00000007", "22", "19960101", "2000-12-31")
    # One account's orders of a range are numbered to show their order.
    order = [F.desc("order_date"), F.desc_nulls_last("order_time"), F.desc("order_no")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("account_id").orderBy(*order)))


@query("order_range_symbol", "C6", ctes(ORDERS) + """
SELECT seen.* FROM seen WHERE account_id = '00000007' AND account_product_code = '22' AND upper(symbol) = 'S49'
AND order_date BETWEEN DATE '1990-01-01' AND DATE '2010-12-31'""", dates="order_date")
def _(t):
    return reads.orders(t.orders().drop("o_orderkey", "o_orderdate"), "00000007", "22", "19900101", "20101231", "S49")


_OBSERVED = """observed AS (
    SELECT concat('o', CAST(o_orderkey AS VARCHAR)) AS id, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS account_id,
           CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN '01' ELSE '22' END AS account_product_code,
           'brokerage' AS account_type, 'domestic' AS market_type,
           make_date(year(o_orderdate), 1, 1) AS start_date, make_date(year(o_orderdate), 12, 31) AS end_date,
           o_orderdate AS fetched_at, o_orderstatus AS data FROM orders)"""


def observations(t):
    rows = t.read("orders")
    year = F.year("o_orderdate")
    return rows.select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"),
        F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("account_id"),
        F.when(F.col("o_orderkey") % 3 == 1, "01").when(F.col("o_orderkey") % 3 == 2, "22").alias("account_product_code"),
        F.lit("brokerage").alias("account_type"), F.lit("domestic").alias("market_type"),
        F.make_date(year, F.lit(1), F.lit(1)).alias("start_date"), F.make_date(year, F.lit(12), F.lit(31)).alias("end_date"),
        F.col("o_orderdate").alias("fetched_at"), F.col("o_orderstatus").alias("data"),
    )


@query("latest_raw_observation", "C7", ctes(_OBSERVED) + """,
asked AS (SELECT DISTINCT account_id, '01' AS account_product_code, market_type, start_date, end_date FROM observed)
SELECT account_id, market_type, start_date, end_date, '01' AS account_product_code, id, account_type, fetched_at, data
FROM (SELECT o.*, row_number() OVER (PARTITION BY asked.account_id, asked.start_date, asked.end_date
             ORDER BY CASE WHEN o.account_product_code = '01' THEN 1 ELSE 0 END DESC, o.fetched_at DESC, o.id DESC) AS rn
      FROM asked JOIN observed o ON o.account_id = asked.account_id AND o.market_type = asked.market_type
       AND o.start_date = asked.start_date AND o.end_date = asked.end_date
       AND (o.account_product_code = '01' OR o.account_product_code IS NULL)) AS ranked WHERE rn = 1""",
       dates="start_date end_date", times="fetched_at")
def _(t):
    seen = observations(t)
    asked = seen.select(
        "account_id", F.lit("01").alias("account_product_code"), "market_type", "start_date", "end_date"
    ).distinct()
    return reads.latest_observations(seen, asked)


def calendar(t):
    return dimensions.trading_calendar(t.years(), t.holidays()).drop("raw_data")


@query("calendar_entry", "C8", ctes(CALENDAR) + "SELECT * FROM calendar WHERE market = 'krx' AND trade_date = DATE '1997-05-01'",
       dates="trade_date")
def _(t):
    return reads.calendar_entry(calendar(t), "krx", "19970501")


@query("calendar_completeness", "C9 E9", """
SELECT market, year, count(*) AS stored_days, CAST(date_diff('day', make_date(year, 1, 1), make_date(year + 1, 1, 1)) AS BIGINT) AS expected_days,
       count(*) >= date_diff('day', make_date(year, 1, 1), make_date(year + 1, 1, 1)) AS complete
FROM (SELECT DISTINCT 'krx' AS market, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_orderdate AS DATE) AS d FROM orders) AS stored
GROUP BY market, year""")
def _(t):
    stored = t.read("orders").select(F.lit("krx").alias("market"), F.col("o_orderdate").cast("date").alias("trade_date"))
    return reads.calendar_completeness(stored.distinct())


@query("master_lookup", "C10", ctes(MASTER) + "SELECT * FROM master WHERE symbol = '000123' AND market = 'KRX'")
def _(t):
    return reads.instrument(t.master(), "000123")


_SYMBOLS = f"wanted AS (SELECT DISTINCT {symbol_sql('l_partkey')} AS symbol FROM lineitem)"


def _wanted(t):
    return t.read("lineitem").select(F.expr(symbol_sql("l_partkey")).alias("symbol"))


@query("master_lookup_many", "C11 I2", ctes(MASTER, _SYMBOLS) + """
SELECT * FROM master WHERE market = 'KRX' AND symbol IN (SELECT symbol FROM wanted)""")
def _(t):
    return reads.instruments(t.master(), _wanted(t))


@query("override_lookup_many", "C11", ctes(OVERRIDES, _SYMBOLS) + """
SELECT * FROM overrides WHERE market = 'KRX' AND symbol IN (SELECT symbol FROM wanted)""")
def _(t):
    return reads.instruments(t.overrides(), _wanted(t))


@query("order_display", "C14", ctes(ORDERS) + """
SELECT order_no, nullif(order_branch_no, '') AS order_branch_no, symbol, strftime(order_date, '%Y%m%d') AS order_date,
       order_time, coalesce(nullif(side_name, ''), side_code) AS side, side_code,
       coalesce(nullif(order_type_name, ''), order_type_code) AS order_type, order_type_code, order_qty, filled_amount
FROM seen""")
def _(t):
    return display_rows(conform(t.orders(), DOMESTIC_ORDERS)).select(
        "order_no", "order_branch_no", "symbol", "order_date", "order_time", "side", "side_code", "order_type",
        "order_type_code", "order_qty", "filled_amount",
    )


@query("distinct_symbols", "I2", f"SELECT DISTINCT {symbol_sql('l_partkey')} AS symbol FROM lineitem")
def _(t):
    return _wanted(t).distinct()


@query("distinct_years", "I2", "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def _(t):
    return t.years()
