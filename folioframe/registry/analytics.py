"""Curation, windows, aggregates, rankings and the time-series analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.functions import limits
from folioframe.operators import curate, rank, reads, windows
from folioframe.plans import assets, moments, portfolio, prices, rates
from folioframe.registry.core import ctes, query
from folioframe.registry.standins import AS_OF, AS_OF_SQL, DAILY, OVERVIEW_DAILY, OVERVIEWS, PRICES, SNAPS, Tables, account_sql, cents_sql
from folioframe.session import materialize, scratch_path

_DAILY = ctes(SNAPS, DAILY)
_ASSETS = ctes(OVERVIEWS, OVERVIEW_DAILY)
_CHANGE = "round((total_eval_amt - prev) / nullif(CAST(prev AS DOUBLE), 0) * 100, 2)"


def daily(t: Tables):
    return curate.portfolio_daily(t.snapshots())


def asset_days(t: Tables):
    return curate.overview_daily(t.overviews())


@query("portfolio_daily_snapshots", "E1", _DAILY + "SELECT account_id, account_type, snap_date, snapshot_at, total_eval_amt FROM daily",
       dates="snap_date", times="snapshot_at")
def _(t):
    return daily(t).drop("balance_data")


@query("portfolio_daily_snapshots_with_payload", "E1", ctes(SNAPS) + """
SELECT account_id, account_type, CAST(snapshot_at AS DATE) AS snap_date, max(snapshot_at) AS snapshot_at,
       arg_max(total_eval_amt, (snapshot_at, id)) AS total_eval_amt,
       arg_max(balance_data, (snapshot_at, id)) AS balance_data
FROM snaps WHERE total_eval_amt IS NOT NULL GROUP BY account_id, account_type, CAST(snapshot_at AS DATE)""",
       dates="snap_date", times="snapshot_at")
def _(t):
    return daily(t)


@query("asset_overview_daily_snapshots", "E2", _ASSETS + "SELECT * FROM overview_daily", dates="snap_date",
       times="snapshot_at")
def _(t):
    return asset_days(t).drop("id")


@query("daily_totals", "E3", _DAILY + """
SELECT 'ALL' AS account_id, snap_date, CAST(sum(total_eval_amt) AS BIGINT) AS total_eval_amt,
       count(DISTINCT account_id) AS account_count FROM daily GROUP BY snap_date""", dates="snap_date")
def _(t):
    return portfolio.daily_totals(daily(t))


@query("daily_totals_one_account", "E3", _DAILY + """
SELECT account_id, snap_date, CAST(sum(total_eval_amt) AS BIGINT) AS total_eval_amt,
       count(DISTINCT account_id) AS account_count FROM daily WHERE account_id = '00000007'
GROUP BY account_id, snap_date""", dates="snap_date")
def _(t):
    return portfolio.daily_totals(daily(t), "00000007")


_MOVES = f"""
paired AS (SELECT account_id, snap_date, total_eval_amt AS today,
                  lag(total_eval_amt) OVER (PARTITION BY account_id ORDER BY snap_date) AS yesterday
           FROM daily WHERE snap_date >= {AS_OF_SQL} - INTERVAL 20 DAY),
moves AS (SELECT account_id, snap_date, today, yesterday,
                 (today - yesterday) / nullif(CAST(yesterday AS DOUBLE), 0) * 100 AS move
          FROM paired WHERE yesterday IS NOT NULL),
placed AS (SELECT *, move - avg(move) OVER own AS off_centre, stddev_samp(move) OVER own AS spread
           FROM moves WINDOW own AS (PARTITION BY account_id))"""


@query("return_statistics", "E4", ctes(SNAPS, DAILY, _MOVES) + """
SELECT account_id, round(avg(move), 4) AS mean_return, round(stddev_samp(move), 4) AS std_return FROM moves
GROUP BY account_id""")
def _(t):
    returns = portfolio.daily_returns(daily(t), 20, AS_OF)
    return returns.groupBy("account_id").agg(
        F.round(F.avg("_return"), 4).alias("mean_return"), F.round(F.stddev_samp("_return"), 4).alias("std_return")
    )


# Values of a hundred accounts over the orders' years, and three lookbacks from one end.
_VALUED = f"""valued AS (
    SELECT {account_sql('o_custkey % 100')} AS account_id, CAST(o_orderdate AS DATE) AS snap_date,
           CAST(sum({cents_sql('o_totalprice')}) AS BIGINT) AS total_eval_amt FROM orders GROUP BY ALL)"""
_LOOKBACKS, _END = (45, 400, 1500), "20010801"
_RETURNS = ",\n".join(f"""
moved{days} AS (SELECT account_id, snap_date, {days} AS lookback,
    (total_eval_amt - lag(total_eval_amt) OVER o) / nullif(CAST(lag(total_eval_amt) OVER o AS DOUBLE), 0) * 100 AS move
    FROM valued WHERE snap_date >= DATE '2001-08-01' - {days} WINDOW o AS (PARTITION BY account_id ORDER BY snap_date))"""
                      for days in _LOOKBACKS)
_MOVED = " UNION ALL ".join(f"SELECT * FROM moved{days}" for days in _LOOKBACKS)


def _kept(t):
    """Returns stored by month and their moments, written once for all lookbacks."""
    daily_values = t.read("orders").groupBy(
        F.expr(account_sql("o_custkey % 100")).alias("account_id"), F.col("o_orderdate").cast("date").alias("snap_date")).agg(
        F.sum(F.expr(cents_sql("o_totalprice"))).cast("bigint").alias("total_eval_amt"))
    returns = materialize(moments.kept_returns(daily_values), scratch_path(t.spark, "returns"))
    return returns, materialize(moments.kept_moments(returns), scratch_path(t.spark, "moments"))


@query("kept_return_statistics", "E4", ctes(_VALUED, _RETURNS) + f"""
SELECT account_id, lookback, count(move) AS n, round(avg(move), 4) AS mean_return, round(stddev_samp(move), 4) AS std_return
FROM ({_MOVED}) AS m GROUP BY account_id, lookback HAVING count(move) > 0""")
def _(t):
    returns, kept = _kept(t)
    out = None
    for days in _LOOKBACKS:
        one = moments.return_statistics(returns, kept, _END, days).select(
            "account_id", F.lit(days).alias("lookback"), "n", F.round("mean", 4).alias("mean_return"), F.round("std", 4).alias("std_return"))
        out = one if out is None else out.unionByName(one)
    return out


@query("kept_return_scores", "G4 E4", ctes(_VALUED, _RETURNS) + """,
known AS (SELECT *, avg(move) OVER own AS mean, stddev_samp(move) OVER own AS std FROM moved400 WINDOW own AS (PARTITION BY account_id))
SELECT account_id, snap_date, round(move, 2) AS return_pct, round((move - mean) / nullif(std, 0), 2) AS z_score
FROM known WHERE move IS NOT NULL AND snap_date >= DATE '2001-08-01' - 30""", dates="snap_date")
def _(t):
    returns, kept = _kept(t)
    return moments.scored_returns(returns, kept, _END, 400, 30)


_LATEST = f"""
latest AS (SELECT account_id, account_type, snap_date, snapshot_at, total_eval_amt FROM (
    SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY snapshot_at DESC) AS rn
    FROM daily WHERE snap_date >= {AS_OF_SQL} - INTERVAL 5 DAY) AS ranked WHERE rn = 1)"""


@query("totals_by_account_type", "E5", ctes(SNAPS, DAILY, _LATEST) + """
SELECT coalesce(account_type, 'ALL') AS account_type, count(*) AS account_count,
       CAST(sum(total_eval_amt) AS BIGINT) AS total_eval_amt, max(snapshot_at) AS latest_snapshot_at
FROM latest GROUP BY ROLLUP (account_type)""", times="latest_snapshot_at")
def _(t):
    return portfolio.totals_by_type(portfolio.latest_summary(daily(t), lookback_days=5, as_of=AS_OF))


@query("valued_days", "E9", _DAILY + "SELECT account_id, count(*) AS days FROM daily GROUP BY account_id")
def _(t):
    return portfolio.valued_days(daily(t))


@query("price_counts", "E9", ctes(PRICES) + "SELECT symbol, exchange, count(*) AS rows FROM prices GROUP BY symbol, exchange")
def _(t):
    return prices.price_counts(t.prices())


@query("latest_row_per_account", "F1", ctes(SNAPS, DAILY, _LATEST) + "SELECT * FROM latest", dates="snap_date",
       times="snapshot_at")
def _(t):
    recent = reads.lookback(daily(t), AS_OF, 5).drop("balance_data")
    return rank.first_per_key(recent, ["account_id"], [F.desc("snapshot_at")], 1)


@query("previous_total_one_series", "F2", _DAILY + """
SELECT snap_date, total_eval_amt, CAST(lag(total_eval_amt) OVER (ORDER BY snap_date) AS BIGINT) AS prev
FROM (SELECT snap_date, CAST(sum(total_eval_amt) AS BIGINT) AS total_eval_amt FROM daily GROUP BY snap_date) AS d""",
       dates="snap_date")
def _(t):
    return portfolio.daily_totals(daily(t)).select(
        "snap_date", "total_eval_amt", windows.previous("total_eval_amt", [], "snap_date").alias("prev")
    )


@query("previous_total_per_account", "F3", _DAILY + """
SELECT account_id, snap_date, total_eval_amt,
       lag(total_eval_amt) OVER (PARTITION BY account_id ORDER BY snap_date) AS prev FROM daily""", dates="snap_date")
def _(t):
    return daily(t).select(
        "account_id", "snap_date", "total_eval_amt",
        windows.previous("total_eval_amt", ["account_id"], "snap_date").alias("prev"),
    )


_FRAME = "OVER (PARTITION BY symbol, exchange ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"


def _rolling(t, column):
    return t.prices().select(
        "symbol", "exchange", "date", column(windows.rolling(["symbol", "exchange"], "date", 7))
    )


@query("rolling_count", "F4", ctes(PRICES) + f"SELECT symbol, exchange, date, count(close) {_FRAME} AS n FROM prices",
       dates="date")
def _(t):
    return _rolling(t, lambda w: windows.rolling_count("close", w).alias("n"))


@query("rolling_mean", "F5", ctes(PRICES) + f"SELECT symbol, exchange, date, round(avg(close) {_FRAME}, 4) AS mean FROM prices",
       dates="date")
def _(t):
    return _rolling(t, lambda w: F.round(windows.rolling_mean("close", w), 4).alias("mean"))


@query("rolling_stddev", "F6", ctes(PRICES) + f"SELECT symbol, exchange, date, round(stddev_samp(close) {_FRAME}, 4) AS std FROM prices",
       dates="date")
def _(t):
    return _rolling(t, lambda w: F.round(windows.rolling_std("close", w), 4).alias("std"))


def _bands_sql(window: int, source: str) -> str:
    over = f"OVER (PARTITION BY symbol, exchange ORDER BY date ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    return f"""
stats AS (SELECT symbol, exchange, date, close, count(close) {over} AS n, avg(close) {over} AS mean,
                 stddev_samp(close) {over} AS std FROM {source} WHERE close IS NOT NULL),
bands AS (SELECT symbol, exchange, date, close, round(mean, 2) AS sma, round(mean + 2e0 * std, 2) AS upper_band,
                 round(mean - 2e0 * std, 2) AS lower_band, round((close - mean) / nullif(std, 0), 2) AS z_score,
                 CASE WHEN close > mean + 2e0 * std THEN '과매수' WHEN close < mean - 2e0 * std THEN '과매도'
                      ELSE '중립' END AS signal
          FROM stats WHERE n >= {window})"""


@query("bollinger_bands_all_symbols", "G1", ctes(PRICES, _bands_sql(10, "prices")) + "SELECT * FROM bands", dates="date")
def _(t):
    return prices.bollinger_bands(t.prices(), window=10)


@query("bollinger_bands_one_symbol", "G1", ctes(PRICES, _bands_sql(10, "prices")) + """
SELECT * FROM bands WHERE symbol = '000007' AND exchange = 'KRX' ORDER BY date DESC LIMIT 12""", dates="date")
def _(t):
    return prices.bollinger_bands(t.prices(), "000007", "KRX", window=10, limit=12)


@query("latest_portfolio_summary", "G2 F1", ctes(SNAPS, DAILY, _LATEST) + "SELECT * FROM latest", dates="snap_date",
       times="snapshot_at")
def _(t):
    return portfolio.latest_summary_of_snapshots(t.snapshots(), lookback_days=5, as_of=AS_OF)


@query("portfolio_daily_change", "G3", _DAILY + f"""
SELECT account_id, snap_date, total_eval_amt, prev AS prev_total_eval_amt, total_eval_amt - prev AS change_amt,
       {_CHANGE} AS change_pct, account_count
FROM (SELECT 'ALL' AS account_id, snap_date, total_eval_amt,
             lag(total_eval_amt) OVER (ORDER BY snap_date) AS prev, account_count
      FROM (SELECT snap_date, CAST(sum(total_eval_amt) AS BIGINT) AS total_eval_amt,
                   count(DISTINCT account_id) AS account_count FROM daily GROUP BY snap_date) AS d) AS c
ORDER BY snap_date DESC LIMIT 14""", dates="snap_date")
def _(t):
    return portfolio.daily_change(daily(t))


@query("portfolio_daily_change_per_account", "G3 F3", _DAILY + f"""
SELECT account_id, snap_date, total_eval_amt, prev AS prev_total_eval_amt, total_eval_amt - prev AS change_amt,
       {_CHANGE} AS change_pct
FROM (SELECT account_id, snap_date, total_eval_amt,
             lag(total_eval_amt) OVER (PARTITION BY account_id ORDER BY snap_date) AS prev,
             row_number() OVER (PARTITION BY account_id ORDER BY snap_date DESC) AS rn FROM daily) AS c
WHERE rn <= 14""", dates="snap_date")
def _(t):
    return portfolio.daily_change_per_account(daily(t))


_SCORED = ctes(SNAPS, DAILY, _MOVES) + """
SELECT account_id, snap_date, today AS total_eval_amt, yesterday AS prev_total_eval_amt, round(move, 2) AS return_pct,
       round(off_centre / nullif(spread, 0), 2) AS z_score,
       CASE WHEN abs(off_centre / nullif(spread, 0)) >= 2e0 THEN '이상치' ELSE '정상' END AS status
FROM placed"""


@query("portfolio_anomalies_all_accounts", "G4 D1", _SCORED, dates="snap_date")
def _(t):
    return portfolio.anomalies(daily(t), lookback_days=20, limit=None, as_of=AS_OF)


@query("portfolio_anomalies_one_account", "G4 H2", _SCORED + """
WHERE account_id = '00000007'
ORDER BY abs(off_centre / nullif(spread, 0)) DESC NULLS LAST, account_id, snap_date LIMIT 20""",
       dates="snap_date")
def _(t):
    return portfolio.anomalies(daily(t), "00000007", lookback_days=20, limit=20, as_of=AS_OF)


@query("returns_joined_to_statistics", "D1", ctes(SNAPS, DAILY, _MOVES) + """
SELECT account_id, snap_date, round(off_centre, 4) AS deviation FROM placed""",
       dates="snap_date")
def _(t):
    returns = portfolio.daily_returns(daily(t), 20, AS_OF)
    stats = returns.groupBy("account_id").agg(F.avg("_return").alias("mean_return"))
    return returns.join(stats, "account_id").select(
        "account_id", "snap_date", F.round(F.col("_return") - F.col("mean_return"), 4).alias("deviation")
    )


def _trend_sql(keys: str, value: str, source: str, short: int, long: int) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    over = f"OVER ({part}ORDER BY snap_date ROWS BETWEEN {{}} PRECEDING AND CURRENT ROW)"
    head = f"{keys}, " if keys else ""
    return f"""
averaged AS (SELECT {head}snap_date, {value}, count({value}) {over.format(long - 1)} AS n,
       round(avg({value}) {over.format(short - 1)}, 0) AS short_sma,
       round(avg({value}) {over.format(long - 1)}, 0) AS long_sma FROM {source}),
trend AS (SELECT {head}snap_date, {value}, short_sma, long_sma,
       CASE WHEN short_sma > long_sma THEN '상승추세' WHEN short_sma < long_sma THEN '하락추세' ELSE '중립' END AS trend
       FROM averaged WHERE n >= {long})"""


_IN_LOOKBACK = f"recent AS (SELECT * FROM daily WHERE snap_date >= {AS_OF_SQL} - INTERVAL 25 DAY)"


@query("portfolio_trend_all_accounts", "G5", ctes(
    SNAPS, DAILY, _IN_LOOKBACK, _trend_sql("account_id", "total_eval_amt", "recent", 3, 10)) + "SELECT * FROM trend",
       dates="snap_date")
def _(t):
    return portfolio.trend(daily(t), short_window=3, long_window=10, lookback_days=25, as_of=AS_OF)


@query("portfolio_trend_one_account", "G5", ctes(
    SNAPS, DAILY, _IN_LOOKBACK, _trend_sql("account_id", "total_eval_amt", "recent", 3, 10)) + """
SELECT * FROM trend WHERE account_id = '00000007'""", dates="snap_date")
def _(t):
    return portfolio.trend(daily(t), "00000007", 3, 10, 25, AS_OF)


@query("total_asset_history", "G6", _ASSETS + f"""
SELECT snap_date, snapshot_at, domestic_eval_amt_krw, overseas_stock_eval_amt_krw, overseas_cash_amt_krw,
       overseas_total_asset_amt_krw, total_eval_amt_krw
FROM overview_daily WHERE snap_date >= {AS_OF_SQL} - INTERVAL 30 DAY""",
       dates="snap_date", times="snapshot_at")
def _(t):
    return assets.history(asset_days(t), 30, as_of=AS_OF)


@query("total_asset_daily_change", "G7", _ASSETS + """
SELECT snap_date, total_eval_amt_krw, prev AS prev_total_eval_amt_krw, total_eval_amt_krw - prev AS change_amt,
       round((total_eval_amt_krw - prev) / nullif(CAST(prev AS DOUBLE), 0) * 100, 2) AS change_pct
FROM (SELECT snap_date, total_eval_amt_krw, lag(total_eval_amt_krw) OVER (ORDER BY snap_date) AS prev
      FROM overview_daily) AS c ORDER BY snap_date DESC LIMIT 14""", dates="snap_date")
def _(t):
    return assets.daily_change(asset_days(t))


@query("total_asset_trend", "G8", ctes(
    OVERVIEWS, OVERVIEW_DAILY,
    f"recent AS (SELECT * FROM overview_daily WHERE snap_date >= {AS_OF_SQL} - INTERVAL 25 DAY)",
    _trend_sql("", "total_eval_amt_krw", "recent", 3, 10)) + "SELECT * FROM trend", dates="snap_date")
def _(t):
    return assets.trend(asset_days(t), 3, 10, 25, AS_OF)


@query("total_asset_allocation_history", "G9", _ASSETS + f"""
SELECT snap_date, domestic_pct, overseas_pct, overseas_stock_pct, overseas_cash_pct, domestic_direct_amt_krw,
       overseas_direct_amt_krw, overseas_indirect_amt_krw, cash_amt_krw, unknown_amt_krw, total_eval_amt_krw
FROM overview_daily WHERE snap_date >= {AS_OF_SQL} - INTERVAL 30 DAY""", dates="snap_date")
def _(t):
    return assets.allocation_history(asset_days(t), 30, AS_OF)


@query("newest_days", "H1", _DAILY + """
SELECT snap_date, account_id, total_eval_amt FROM daily ORDER BY snap_date DESC, account_id LIMIT 25""",
       dates="snap_date")
def _(t):
    return rank.newest(daily(t).select("snap_date", "account_id", "total_eval_amt"), 25, "snap_date", "account_id")


@query("largest_returns_first", "H2", ctes(SNAPS, DAILY, _MOVES) + """
SELECT account_id, snap_date, round(move, 2) AS return_pct FROM moves
ORDER BY abs(move) DESC NULLS LAST, account_id, snap_date LIMIT 40""", dates="snap_date")
def _(t):
    returns = portfolio.daily_returns(daily(t), 20, AS_OF)
    return rank.largest_first(returns, F.abs("_return"), 40, "account_id", "snap_date").select(
        "account_id", "snap_date", F.round("_return", 2).alias("return_pct")
    )


@query("summary_sorted", "H5", ctes(SNAPS, DAILY, _LATEST) + """
SELECT CAST(row_number() OVER (PARTITION BY account_type ORDER BY account_id) AS INTEGER) AS place, account_type, account_id
FROM latest""")
def _(t):
    summary = portfolio.latest_summary(daily(t), lookback_days=5, as_of=AS_OF)
    # The order of the whole sort shows in each type's numbers; no task numbers all accounts.
    return summary.select("account_type", "account_id", F.row_number().over(
        windows.series(["account_type"], "account_id")).alias("place"))


@query("lookback_as_long_as_asked", "C12 C13", _DAILY + f"""
SELECT account_id, snap_date, total_eval_amt FROM daily WHERE snap_date >= {AS_OF_SQL} - INTERVAL 99999 DAY""",
       dates="snap_date")
def _(t):
    return reads.lookback(daily(t), AS_OF, 99_999).select("account_id", "snap_date", "total_eval_amt")


@query("trend_with_equal_windows", "C13", ctes(
    SNAPS, DAILY, f"recent AS (SELECT * FROM daily WHERE snap_date >= {AS_OF_SQL} - INTERVAL 12 DAY)",
    _trend_sql("account_id", "total_eval_amt", "recent", 12, 12)) + "SELECT * FROM trend", dates="snap_date")
def _(t):
    short, long, days = limits.trend_windows(12, 12, 12)
    return portfolio.trend(daily(t), short_window=short, long_window=long, lookback_days=days, as_of=AS_OF)


# Every line is a holding of one of the accounts that the events value, in snapshots of several a day over the three
# months up to the end of the events.
_HELD_AT = "DATE '2023-11-01' + CAST(l_orderkey % 91 AS INT)"
_HELD = f"""held AS (
    SELECT {account_sql('l_suppkey')} AS account_id, {_HELD_AT} + to_hours(l_linenumber) AS holdings_at,
           CAST(sum({cents_sql('l_extendedprice / 100000')}) AS BIGINT) AS holdings_amt, count(*) AS holding_count
    FROM lineitem GROUP BY ALL)"""


@query("account_nav_daily", "M E1 G14", _DAILY + f"""
, {_HELD},
days AS (SELECT account_id, snap_date, CAST(sum(total_eval_amt) AS BIGINT) AS total_eval_amt FROM daily GROUP BY 1, 2)
SELECT days.account_id, snap_date, total_eval_amt, holdings_at, holdings_amt, holding_count,
       greatest(total_eval_amt - coalesce(holdings_amt, 0), 0) AS cash_amt
FROM days ASOF LEFT JOIN held
ON days.account_id = held.account_id AND days.snap_date + INTERVAL 1 DAY > held.holdings_at""",
       dates="snap_date", times="holdings_at")
def _(t):
    held = t.read("lineitem").select(
        F.expr(account_sql("l_suppkey")).alias("account_id"),
        (F.expr(_HELD_AT).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("l_linenumber"))).alias("snapshot_at"),
        F.expr(cents_sql("l_extendedprice / 100000")).alias("value_krw"))
    return portfolio.account_nav(daily(t), held)


_QUOTED = """quoted AS (
    SELECT concat('c', CAST(o_custkey % 97 AS VARCHAR(20))) AS currency, CAST(o_orderdate AS DATE) AS date,
           CASE WHEN o_orderkey % 4 = 0 THEN 'W' ELSE 'D' END AS period,
           CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 43 = 0 THEN 0.0 ELSE o_totalprice END AS rate,
           o_orderkey AS seq FROM orders)"""


@query("fx_daily", "M B3", ctes(_QUOTED) + """,
observed AS (SELECT upper(currency) AS currency, date, arg_max(rate, seq) AS rate FROM quoted
             WHERE period = 'D' AND rate <> 0 GROUP BY upper(currency), date),
spine AS (SELECT currency, CAST(unnest(generate_series(first, (SELECT max(date) FROM observed), INTERVAL 1 DAY)) AS DATE) AS date
          FROM (SELECT currency, min(date) AS first FROM observed GROUP BY currency)),
filled AS (SELECT currency, date, last_value(rate IGNORE NULLS) OVER w AS rate,
                  last_value(CASE WHEN rate IS NOT NULL THEN date END IGNORE NULLS) OVER w AS rate_date
           FROM spine LEFT JOIN observed USING (currency, date) WINDOW w AS (PARTITION BY currency ORDER BY date))
SELECT *, CAST(date - rate_date AS INTEGER) AS stale_days FROM filled""", dates="date rate_date")
def _(t):
    quoted = t.spark.sql(_QUOTED[len("quoted AS ("):-1].replace("FROM orders", "FROM {orders}"), orders=t.read("orders"))
    return rates.fx_daily(quoted, order=["seq"])


@query("last_value_per_minute", "M K3", ctes(SNAPS) + """
SELECT account_id, account_type, date_trunc('minute', snapshot_at) AS snap_minute, max(snapshot_at) AS snapshot_at,
       arg_max(total_eval_amt, (snapshot_at, id)) AS total_eval_amt
FROM snaps WHERE total_eval_amt IS NOT NULL GROUP BY account_id, account_type, date_trunc('minute', snapshot_at)""",
       times="snap_minute snapshot_at")
def _(t):
    return curate.last_per_minute(t.snapshots())
