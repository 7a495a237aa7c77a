"""Column expressions over texts built from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.functions import labels, numbers, payload, text
from folioframe.functions.classify import classify
from folioframe.operators import curate
from folioframe.registry.core import ctes, query
from folioframe.registry.standins import MASTER, OVERRIDES, PRICES, SNAPS, cents_sql
from folioframe.sources import balances, dimensions

_NUMBER = f"""CASE WHEN o_orderkey % 13 = 0 THEN concat(CAST(o_custkey AS VARCHAR(9)), 'd')
    WHEN o_orderkey % 13 = 1 THEN concat(CAST(o_custkey AS VARCHAR(9)), '.5F ') ELSE CASE o_orderkey % 10
    WHEN 0 THEN '' WHEN 1 THEN '-' WHEN 2 THEN NULL WHEN 3 THEN concat('$1,', CAST(o_custkey % 900 + 100 AS VARCHAR(9)))
    WHEN 4 THEN concat(CAST(o_custkey AS VARCHAR(9)), '.5%') WHEN 5 THEN concat(' -', CAST(o_custkey AS VARCHAR(9)), ' ')
    WHEN 6 THEN 'n/a' WHEN 7 THEN concat(CAST(o_custkey AS VARCHAR(9)), ',000') WHEN 8 THEN '0'
    ELSE concat(CAST(o_custkey AS VARCHAR(9)), '.0') END END"""
_DAY = """CASE o_orderkey % 6 WHEN 0 THEN '20240230' WHEN 1 THEN '' WHEN 2 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10))
    WHEN 3 THEN NULL ELSE replace(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), '-', '') END"""
_WORD = """CASE o_orderkey % 5 WHEN 0 THEN 'Y' WHEN 1 THEN 'n' WHEN 2 THEN '' WHEN 3 THEN 'maybe' ELSE NULL END"""
_TEXTS = f"texts AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, {_NUMBER} AS number, {_DAY} AS day, {_WORD} AS word FROM orders)"
_CLEAN = "replace(replace(replace(number, ',', ''), '$', ''), '%', '')"
_PLAIN = "replace(number, ',', '')"


def texts(t):
    return t.read("orders").selectExpr(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice",
        f"{_NUMBER} AS number", f"{_DAY} AS day", f"{_WORD} AS word",
    )


def _scalar(name, units, expression, sql, **render):
    """A query of one expression over the texts, keyed by the order."""
    @query(name, units, ctes(_TEXTS) + f"SELECT o_orderkey, {sql} AS result FROM texts", **render)
    def _(t):
        return texts(t).select("o_orderkey", expression().alias("result"))


_scalar("parse_number", "J1", lambda: numbers.parse_number(F.col("number")), f"TRY_CAST(trim({_CLEAN}) AS DOUBLE)")
_scalar("parse_int", "J2", lambda: numbers.parse_int(F.col("number")),
        f"CAST(trunc(TRY_CAST(trim({_CLEAN}) AS DOUBLE)) AS BIGINT)")
_scalar("strict_int", "J3", lambda: numbers.strict_int(F.col("number")),
        f"CASE WHEN regexp_matches(trim({_PLAIN}), '^[-+]?[0-9]+$') THEN TRY_CAST(trim({_PLAIN}) AS BIGINT) END")
_scalar("strict_float", "J3", lambda: numbers.strict_float(F.col("number")), f"TRY_CAST(trim({_PLAIN}) AS DOUBLE)")
_scalar("lenient_int", "J4", lambda: numbers.lenient_int(F.col("number")),
        f"CAST(trunc(TRY_CAST(trim({_PLAIN}) AS DOUBLE)) AS BIGINT)")
_scalar("parse_day", "J11", lambda: text.parse_day(F.col("day")),
        "CASE WHEN length(day) = 8 THEN CAST(try_strptime(day, '%Y%m%d') AS DATE) END", dates="result")
_scalar("parse_day_or_iso", "J11", lambda: text.parse_day_or_iso(F.col("day")),
        "CAST(try_strptime(nullif(replace(day, '-', ''), ''), '%Y%m%d') AS DATE)", dates="result")
_scalar("yes_no", "J13", lambda: text.yes_no(F.col("word")),
        "CASE WHEN word IN ('Y', 'y') THEN true WHEN word IN ('N', 'n') THEN false END")
_scalar("first_filled", "J14", lambda: text.first_filled(F.col("word"), F.col("day"), F.col("o_orderpriority")),
        "coalesce(nullif(word, ''), nullif(day, ''), nullif(o_orderpriority, ''))")


@query("masked_number", "J15", """
SELECT c_custkey, CASE WHEN length(n) <= 4 THEN repeat('*', length(n))
       ELSE concat(substring(n, 1, 2), repeat('*', length(n) - 4), right(n, 2)) END AS masked
FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE c_name END AS n FROM customer) AS c""")
def _(t):
    number = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise(F.col("c_name"))
    return t.read("customer").select("c_custkey", text.mask(number).alias("masked"))


@query("total_value", "J5", f"""
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 5 THEN NULL WHEN 6 THEN NULL
       ELSE CAST(trunc({cents_sql('o_totalprice')} / 100e0) AS BIGINT) END AS total FROM orders""")
def _(t):
    # A leading member, an empty one before it, a list, an object, a JSON zero to skip, bad text, no members.
    shape = F.col("o_orderkey") % 7
    amount = F.format_number((F.expr(cents_sql("o_totalprice")) / 100.0), 2)
    quoted = F.concat(F.lit('"'), amount, F.lit('"'))
    doc = (
        F.when(shape == 0, F.concat(F.lit('{"output2":{"tot_evlu_amt":'), quoted, F.lit("}}")))
        .when(shape == 1, F.concat(F.lit('{"output2":[{"tot_evlu_amt":"","scts_evlu_amt":'), quoted, F.lit("},{}]}")))
        .when(shape == 2, F.concat(F.lit('{"output2":{"tot_evlu_amt":0,"tot_asst_amt":'), quoted, F.lit("}}")))
        .when(shape == 3, F.concat(F.lit('{"output2":{"evlu_amt_smtl_amt":'), quoted, F.lit(',"dnca_tota":"1"}}')))
        .when(shape == 4, F.concat(F.lit('{"output2":{"dnca_tot_amt":null,"dnca_tota":'), quoted, F.lit("}}")))
        .when(shape == 5, F.concat(F.lit('{"output2":{"tot_evlu_amt":"bad","dnca_tota":'), quoted, F.lit("}}")))
        .otherwise('{"output2":[]}')
    )
    return t.read("orders").select("o_orderkey", balances.total_value(doc).alias("total"))


@query("classified_instruments", "J6", ctes(MASTER, OVERRIDES) + """,
hints AS (SELECT master.symbol, upper(name) AS n, trim(group_code) AS g, exposure_type AS ox, exposure_region AS orr,
                 asset_subtype AS oa, overrides.symbol IS NOT NULL AS manual
          FROM master LEFT JOIN overrides ON overrides.symbol = master.symbol),
told AS (SELECT *, regexp_matches(n, '미국|나스닥|S&P|글로벌|GLOBAL|해외|선진국|신흥국|중국|일본|인도|베트남') AS abroad,
                regexp_matches(n, 'KOREA|코리아|코스피|코스닥|K수출|K제조업|제조업|삼성전자|SK하이닉스|밸류업') AS home,
                g IN ('E', 'EF') OR regexp_matches(n, 'KODEX|TIGER|ACE|RISE|TIME|KOACT|PLUS|SOL|HANARO|KBSTAR|ARIRANG|WOORI|REIT|리츠|부동산') AS fund,
                g IN ('R', 'RT') AS reit FROM hints)
SELECT symbol,
       CASE WHEN manual THEN CASE WHEN ox IN ('domestic_direct', 'overseas_direct', 'overseas_indirect', 'cash', 'unknown') THEN ox ELSE 'unknown' END
            WHEN g = 'FE' THEN 'overseas_indirect'
            WHEN (reit OR fund) AND abroad AND NOT home THEN 'overseas_indirect'
            WHEN (reit OR fund) AND home AND NOT abroad THEN 'domestic_direct'
            WHEN reit OR fund THEN 'unknown' ELSE 'domestic_direct' END AS exposure_type,
       CASE WHEN manual THEN orr WHEN g = 'FE' THEN 'global'
            WHEN (reit OR fund) AND abroad AND NOT home THEN 'global'
            WHEN reit THEN 'kr' WHEN fund AND home AND NOT abroad THEN 'kr' WHEN fund THEN NULL
            ELSE 'kr' END AS exposure_region,
       CASE WHEN manual THEN oa WHEN g = 'FE' THEN 'etf' WHEN reit THEN 'reit' WHEN fund THEN 'etf' ELSE 'equity' END AS asset_subtype,
       CASE WHEN manual OR g = 'FE' THEN 'high' WHEN (reit OR fund) AND abroad <> home THEN 'medium'
            WHEN reit OR fund THEN 'low' ELSE 'high' END AS confidence,
       CASE WHEN manual THEN 'override' WHEN g = 'FE' THEN 'instrument_master' WHEN reit OR fund THEN 'heuristic'
            ELSE 'default' END AS source,
       CASE WHEN manual OR g = 'FE' OR abroad <> home THEN NULL WHEN reit THEN 'REIT 상품의 투자지역이 모호합니다.'
            WHEN fund THEN 'ETF/REIT 해외노출 분류가 애매합니다.' END AS warning
FROM told""")
def _(t):
    manual = t.overrides().select("symbol", F.struct("exposure_type", "exposure_region", "asset_subtype").alias("o"))
    rows = t.master().join(manual, "symbol", "left")
    return rows.select("symbol", classify(F.col("name"), F.col("group_code"), F.col("o")).alias("c")).select(
        "symbol", "c.*"
    )


_LINE = "round(CAST({0} AS DOUBLE) / nullif(CAST({1} AS DOUBLE), 0) * 100, 2)"


@query("percentage", "J7", "SELECT o_orderkey, " + _LINE.format(
    cents_sql("o_totalprice"), "o_custkey % 50") + " AS pct FROM orders")
def _(t):
    return t.read("orders").select(
        "o_orderkey", numbers.pct(F.expr(cents_sql("o_totalprice")), F.col("o_custkey") % 50).alias("pct")
    )


@query("safe_ratio", "J8", """
SELECT o_orderkey, round(o_orderkey / nullif(CAST(o_custkey % 50 AS DOUBLE), 0) * 100, 6) AS ratio FROM orders""")
def _(t):
    return t.read("orders").select(
        "o_orderkey", F.round(numbers.ratio_pct(F.col("o_orderkey"), F.col("o_custkey") % 50), 6).alias("ratio")
    )


_SPREAD = "spread AS (SELECT symbol, avg(close) AS mean, stddev_samp(close) AS std FROM prices GROUP BY symbol)"


@query("z_scores", "J9", ctes(PRICES, _SPREAD) + """
SELECT prices.symbol, date, round((close - mean) / nullif(std, 0), 2) AS z FROM prices JOIN spread USING (symbol)""",
       dates="date")
def _(t):
    rows = t.prices()
    spread = rows.groupBy("symbol").agg(F.avg("close").alias("mean"), F.stddev_samp("close").alias("std"))
    z = numbers.z_score(F.col("close"), F.col("mean"), F.col("std"))
    return rows.join(spread, "symbol").select("symbol", "date", F.round(z, 2).alias("z"))


@query("labels", "J10", ctes(PRICES) + """
SELECT symbol, date, CASE WHEN close > high THEN 'over' WHEN close < high - 1000 THEN 'under' ELSE 'in' END AS band,
       CASE WHEN close > open THEN '상승추세' WHEN close < open THEN '하락추세' ELSE '중립' END AS trend,
       CASE WHEN abs((close - open) / nullif(high - low, 0)) >= 0.5e0 THEN '이상치' ELSE '정상' END AS status FROM prices""",
       dates="date")
def _(t):
    close, high, low, start = F.col("close"), F.col("high"), F.col("low"), F.col("open")
    return t.prices().select(
        "symbol", "date",
        labels.band_signal(close, high, high - 1000, labels.BandLabels("over", "under", "in")).alias("band"),
        labels.trend(close, start).alias("trend"),
        labels.anomaly_status(numbers.z_score(close, start, high - low), 0.5).alias("status"),
    )


@query("seoul_days", "J12", """
SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 9 HOUR ELSE CAST(ts AS DATE) END AS DATE) AS day FROM events""",
       dates="day")
def _(t):
    token = F.when(F.col("event_id") % 4 == 0, F.lit(" Today ")).when(F.col("event_id") % 2 == 0, F.lit("")).otherwise(
        F.date_format("ts", "yyyyMMdd"))
    return t.read("events").select("event_id", text.resolve_day(token, F.col("ts")).alias("day"))


@query("json_round_trip", "J16", """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'not json' ELSE json_extract_string(props, '$.k') END AS k,
       concat('{"event_id":', event_id, ',"missing":null}') AS encoded FROM events""")
def _(t):
    stored = F.when(F.col("event_id") % 5 == 0, "not json").otherwise(F.col("props"))
    rows = t.read("events").select("event_id", text.decode_json(stored).alias("doc"))
    plain = F.try_variant_get("doc", "$", "string")
    return rows.select(
        "event_id",
        F.when(payload.is_object(F.col("doc")), F.try_variant_get("doc", "$.k", "string")).otherwise(plain).alias("k"),
        text.encode_json(F.struct("event_id", F.lit(None).cast("string").alias("missing"))).alias("encoded"),
    )


_EXCHANGE = """CASE l_suppkey % 10 WHEN 0 THEN 'NASD' WHEN 1 THEN 'NYSE' WHEN 2 THEN 'AMEX' WHEN 3 THEN 'SEHK' WHEN 4 THEN 'SHAA'
    WHEN 5 THEN 'SZAA' WHEN 6 THEN 'TKSE' WHEN 7 THEN 'HASE' WHEN 8 THEN 'VNSE' ELSE 'LSE' END"""


@query("exchange_currencies", "J17", f"""
SELECT exchange, CASE exchange WHEN 'SEHK' THEN 'HKD' WHEN 'SHAA' THEN 'CNY' WHEN 'SZAA' THEN 'CNY' WHEN 'TKSE' THEN 'JPY'
       WHEN 'HASE' THEN 'VND' WHEN 'VNSE' THEN 'VND' ELSE 'USD' END AS currency, count(*) AS rows
FROM (SELECT {_EXCHANGE} AS exchange FROM lineitem) AS l GROUP BY 1, 2""")
def _(t):
    rows = t.read("lineitem").select(F.expr(_EXCHANGE).alias("exchange"))
    return rows.groupBy("exchange", text.exchange_currency(F.col("exchange")).alias("currency")).agg(
        F.count(F.lit(1)).alias("rows")
    )


@query("iso_rendering", "J18", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day,
       concat(strftime(t, '%Y-%m-%dT%H:%M:%S'), CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE strftime(t, '.%f') END) AS at
FROM (SELECT o_orderkey, o_orderdate, o_orderdate + to_microseconds(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1234 END) AS t
      FROM orders) AS o""")
def _(t):
    fraction = F.when(F.col("o_orderkey") % 3 == 0, F.lit(0)).otherwise(F.lit(0.001234)).cast("decimal(18,6)")
    at = F.col("o_orderdate") + F.make_dt_interval(secs=fraction)
    return t.read("orders").select(
        "o_orderkey", text.iso_day(F.col("o_orderdate")).alias("day"), text.iso_time(at).alias("at")
    )


@query("account_types", "A13", """
SELECT c_custkey, CASE WHEN label IN ('ria', 'isa', 'brokerage', 'irp', 'pension') THEN label
       WHEN code = '01' THEN 'brokerage' WHEN code = '22' THEN 'pension' WHEN code = '29' THEN 'irp' ELSE 'unknown' END AS account_type,
       code = '29' AS pension_api
FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'isa' WHEN 1 THEN 'other' END AS label,
             CASE c_custkey % 4 WHEN 0 THEN '01' WHEN 1 THEN '22' WHEN 2 THEN '29' ELSE '99' END AS code FROM customer) AS c""")
def _(t):
    label = F.when(F.col("c_custkey") % 3 == 0, "isa").when(F.col("c_custkey") % 3 == 1, "other")
    code = F.element_at(F.array(*[F.lit(c) for c in ("01", "22", "29", "99")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return t.read("customer").select(
        "c_custkey", dimensions.account_type(label, code).alias("account_type"),
        dimensions.uses_pension_api(code).alias("pension_api"),
    )


@query("daily_last_hashed", "E1", ctes(SNAPS) + """
SELECT account_id, account_type, CAST(snapshot_at AS DATE) AS snap_date, max(snapshot_at) AS snapshot_at,
       arg_max(total_eval_amt, snapshot_at) AS total_eval_amt
FROM snaps WHERE total_eval_amt IS NOT NULL GROUP BY account_id, account_type, CAST(snapshot_at AS DATE)""",
       dates="snap_date", times="snapshot_at")
def _(t):
    return curate.portfolio_daily(t.snapshots().drop("balance_data"), tie_breaker=None)
