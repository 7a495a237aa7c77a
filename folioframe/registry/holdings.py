"""Holdings, valuation and the total-asset overview.

Owners are customers. Their domestic holdings are the line items of status O, their overseas holdings the
others; deposits and account values come from the customer and the orders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.functions.classify import EXPOSURES
from folioframe.operators import append, rank, tables
from folioframe.operators.curate import latest_snapshots
from folioframe.plans import holdings as H
from folioframe.plans import overview
from folioframe.registry.core import ctes, query
from folioframe.registry.standins import ACCOUNTS, MASTER, OVERRIDES, cents_sql, symbol_sql
from folioframe.session import drop_scratch, materialize, scratch_path
from folioframe.sources import balances
from folioframe.sources.dimensions import account_dimension

BY = ["owner_id"]
_CENTS = cents_sql("l_extendedprice")
_CURRENCY = "concat('C', CAST(l_suppkey AS VARCHAR(20)))"


def _lines(t):
    owners = t.read("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("owner_id"))
    lines = t.read("lineitem")
    total = lines.count()
    return H.dealt(lines, total, "l_orderkey").join(H.dealt(owners, total, "l_orderkey"), "l_orderkey")


def domestic(t, lines=None):
    """Domestic holdings: by default, where they meet overseas ones, the lines of status O."""
    return (_lines(t).filter("l_linestatus = 'O'") if lines is None else lines).select(
        "owner_id", F.when(F.col("l_returnflag") == "A", "isa").otherwise("brokerage").alias("account_label"),
        F.expr(symbol_sql("l_partkey")).alias("symbol"), "l_partkey", F.col("l_quantity").alias("quantity"),
        F.expr(_CENTS).alias("value_krw"), F.lit(None).cast("string").alias("raw_data"),
    ).join(t.read("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name")), "l_partkey").drop(
        "l_partkey")


def overseas(t, lines=None):
    """Overseas holdings: by default, where they meet domestic ones, the lines of other statuses. They are dealt as
    they meet their rates and are summed by currency."""
    held = (_lines(t).filter("l_linestatus <> 'O'") if lines is None else lines).select(
        "owner_id", F.lit("ria").alias("account_label"), F.lit("NASD").alias("exchange"),
        F.expr(symbol_sql("l_partkey")).alias("symbol"), F.lit("stock").alias("name"),
        F.expr(_CURRENCY).alias("currency"), F.col("l_quantity").alias("quantity"),
        F.expr(_CENTS).cast("double").alias("value_foreign"), F.lit(None).cast("double").alias("profit_foreign"),
        F.lit(None).cast("double").alias("profit_rate_pct"), F.lit(None).cast("string").alias("raw_data"),
    )
    return H.dealt(held, t.read("lineitem").count(), "owner_id", "currency")


def rates(t, held=None):
    """A rate per owner and currency they hold; every seventh currency has none, every fifth a rate of 0."""
    pairs = (overseas(t) if held is None else held).select("owner_id", "currency").distinct()
    number = F.substring("currency", 2, 20).cast("bigint")
    return pairs.filter(number % 7 != 0).withColumn("rate", F.when(number % 5 == 0, 0.0).otherwise((number % 9 + 1).cast("double")))


_RATE = "CASE WHEN l_suppkey % 7 = 0 OR l_suppkey % 5 = 0 THEN NULL ELSE CAST(l_suppkey % 9 + 1 AS DOUBLE) END"


def cash(t):
    total = F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).when(F.col("c_custkey") % 3 == 1, F.lit(0)).otherwise(500_000_000)
    return t.read("customer").select(
        F.col("c_custkey").alias("owner_id"), F.lit("ria").alias("account_label"), total.cast("bigint").alias("total_asset_amt_krw"),
        (F.col("c_custkey") * 1000).alias("cash_from_fields_amt_krw"),
    )


def values(t):
    """Two accounts an owner, valued from their orders."""
    totals = t.read("orders").groupBy(F.col("o_custkey").alias("owner_id")).agg(
        F.sum(F.expr(cents_sql("o_totalprice"))).alias("total"))
    account = F.explode(F.array(F.lit("isa"), F.lit("brokerage")))
    return totals.select("owner_id", "total", account.alias("account_label")).select(
        "owner_id", "account_label", F.upper("account_label").alias("display_name"),
        F.when(F.col("account_label") == "isa", F.lit(1000)).otherwise(F.col("total")).alias("value_krw"),
    )


def classified(t, lines=None):
    return H.classify_holdings(domestic(t, lines), t.master(), t.overrides())


def valuation(t, **options):
    """Every line an overseas holding."""
    held = overseas(t, _lines(t))
    return overview.overseas_valuation(held, cash(t), rates(t, held), BY, **options)


_BASE = f"""
lines AS (SELECT o_custkey AS owner_id, l.*, {symbol_sql('l_partkey')} AS symbol, {_CENTS} AS cents, {_RATE} AS rate
          FROM lineitem l JOIN orders ON o_orderkey = l_orderkey)"""
_CLASSED = """
hinted AS (SELECT lines.owner_id, lines.symbol, p_name, CASE WHEN l_returnflag = 'A' THEN 'isa' ELSE 'brokerage' END AS account_label,
                  l_quantity, cents, trim(m.group_code) AS g, o.symbol IS NOT NULL AS manual, o.exposure_type AS ox, o.exposure_region AS orr,
                  o.asset_subtype AS oa, regexp_matches(upper(p_name), 'S&P|GLOBAL') AS abroad, regexp_matches(upper(p_name), 'KOREA') AS home,
                  g IN ('E', 'EF') OR regexp_matches(upper(p_name), 'KODEX|TIGER|ACE|RISE|TIME|KOACT|PLUS|SOL|HANARO|KBSTAR|ARIRANG|WOORI|REIT') AS fund,
                  g IN ('R', 'RT') AS reit
           FROM lines JOIN part ON p_partkey = l_partkey LEFT JOIN master m ON m.symbol = lines.symbol
           LEFT JOIN overrides o ON o.symbol = lines.symbol WHERE l_linestatus = 'O'),
classed AS (SELECT owner_id, account_label, symbol, p_name AS name, l_quantity AS quantity, cents AS value_krw,
                   CASE WHEN manual THEN CASE WHEN ox IN ('overseas_indirect', 'domestic_direct') THEN ox ELSE 'unknown' END
                        WHEN g = 'FE' THEN 'overseas_indirect' WHEN (reit OR fund) AND abroad AND NOT home THEN 'overseas_indirect'
                        WHEN (reit OR fund) AND home AND NOT abroad THEN 'domestic_direct' WHEN reit OR fund THEN 'unknown'
                        ELSE 'domestic_direct' END AS exposure_type,
                   CASE WHEN manual OR g = 'FE' THEN 'high' WHEN (reit OR fund) AND abroad <> home THEN 'medium'
                        WHEN reit OR fund THEN 'low' ELSE 'high' END AS confidence,
                   CASE WHEN manual THEN 'override' WHEN g = 'FE' THEN 'instrument_master' WHEN reit OR fund THEN 'heuristic' ELSE 'default' END AS source,
                   CASE WHEN manual OR g = 'FE' OR abroad <> home THEN NULL WHEN reit THEN 'REIT 상품의 투자지역이 모호합니다.'
                        WHEN fund THEN 'ETF/REIT 해외노출 분류가 애매합니다.' END AS warning
            FROM hinted)"""
_VALUED = """
valued AS (SELECT owner_id, symbol, concat('C', l_suppkey) AS currency, l_quantity AS quantity, CAST(cents AS DOUBLE) AS value_foreign, rate AS fx_rate,
                  CAST(trunc(cents * rate) AS BIGINT) AS value_krw FROM lines WHERE l_linestatus <> 'O')"""
# Where only one side is looked at, every line is a holding of that side.
_DOMESTIC = ctes(_BASE, MASTER, OVERRIDES, _CLASSED.replace(" WHERE l_linestatus = 'O'", ""))
_OVERSEAS = _VALUED.replace(" WHERE l_linestatus <> 'O'", "")


@query("classified_holdings", "D2 J6", _DOMESTIC + """
SELECT owner_id, account_label, symbol, name, quantity, value_krw, exposure_type, confidence, source, warning FROM classed""")
def _(t):
    return classified(t, _lines(t)).drop("raw_data", "exposure_region", "asset_subtype")


@query("classification_warnings", "G11 J6", _DOMESTIC + """
SELECT owner_id, account_label, symbol, name, warning AS reason, confidence, source FROM classed WHERE warning IS NOT NULL""")
def _(t):
    return H.warnings(classified(t, _lines(t)), BY)


_FIVE = ", ".join(f"CAST(coalesce(sum(CASE WHEN exposure_type = '{name}' THEN value_krw END), 0) AS BIGINT) AS {name}" for name in EXPOSURES)


@query("exposure_amounts", "E7", _DOMESTIC + f"SELECT owner_id, {_FIVE} FROM classed GROUP BY owner_id")
def _(t):
    return H.exposure_amounts(classified(t, _lines(t)), BY)


@query("valued_overseas_holdings", "D5", ctes(_BASE, _OVERSEAS) + "SELECT * FROM valued")
def _(t):
    held = overseas(t, _lines(t))
    return H.value_overseas(held, rates(t, held), BY).select(
        "owner_id", "symbol", "currency", "quantity", "value_foreign", "fx_rate", "value_krw")


@query("overseas_by_currency", "E6 H5", ctes(_BASE, _OVERSEAS) + """
SELECT owner_id, currency, round(sum(value_foreign), 2) AS value_foreign, max(fx_rate) AS fx_rate,
       nullif(CAST(trunc(sum(value_foreign * fx_rate)) AS BIGINT), 0) AS value_krw FROM valued GROUP BY owner_id, currency""")
def _(t):
    return valuation(t).by_currency


_CASH = """
deposits AS (SELECT c_custkey AS owner_id, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 500000000 END AS reported,
                    c_custkey * 1000 AS cash FROM customer),
stocks AS (SELECT owner_id, CAST(coalesce(sum(value_krw), 0) AS BIGINT) AS stock, count(*) AS n FROM valued GROUP BY owner_id),
parts AS (SELECT coalesce(d.owner_id, s.owner_id) AS owner_id, coalesce(stock, 0) AS stock, reported, coalesce(n, 0) AS n,
                 CAST(coalesce(nullif(reported, 0), coalesce(stock, 0) + coalesce(cash, 0)) AS BIGINT) AS total
          FROM deposits d FULL JOIN stocks s ON s.owner_id = d.owner_id)"""
_TOTALS = """owner_id, 'ria' AS overseas_account_label, stock AS overseas_stock_eval_amt_krw, total AS overseas_total_asset_amt_krw,
       CAST(greatest(total - stock, 0) AS BIGINT) AS overseas_cash_amt_krw, n AS overseas_holdings_count,
       CASE WHEN reported IS NOT NULL THEN 'overseas_deposit.예수금_총계.총자산금액' ELSE 'stock_eval_plus_deposit_cash_fields' END AS total_asset_source"""


@query("overseas_valuation_totals", "G10", ctes(_BASE, _OVERSEAS, _CASH) + f"SELECT {_TOTALS} FROM parts")
def _(t):
    return valuation(t).totals


_TOP = """
ranked AS (SELECT owner_id, symbol, value_krw, round(value_foreign, 2) AS value_foreign, currency,
                  CAST(row_number() OVER (PARTITION BY owner_id ORDER BY coalesce(value_krw, 0) DESC, symbol, currency, round(value_foreign, 2), quantity) AS INTEGER) AS place FROM valued),
listed AS (SELECT owner_id, place, symbol AS label, value_krw, value_foreign, currency FROM ranked WHERE place <= 3
           UNION ALL SELECT owner_id, 4, '기타 해외주식', CAST(sum(coalesce(value_krw, 0)) AS BIGINT), NULL, NULL FROM ranked WHERE place > 3 GROUP BY owner_id)"""
_SHARE = "round(CAST(value_krw AS DOUBLE) / nullif(CAST({0} AS DOUBLE), 0) * 100, 2) AS {1}"


@query("overseas_top_holdings", "H4 G10 J7", ctes(_BASE, _OVERSEAS, _CASH, _TOP) + f"""
SELECT owner_id, place, label, value_krw, value_foreign, currency, {_SHARE.format('stock', 'pct_of_overseas_stock')}, {_SHARE.format('total', 'pct_of_overseas_total')}
FROM listed JOIN parts USING (owner_id)""")
def _(t):
    return valuation(t, top_n=3).top


@query("top_parts_with_other", "H4", f"""
WITH ranked AS (SELECT l_suppkey, CAST(l_orderkey AS VARCHAR) AS label, {_CENTS} AS value,
    CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY {_CENTS} DESC, l_orderkey, l_linenumber) AS INTEGER) AS place FROM lineitem)
SELECT l_suppkey, place, label, value FROM ranked WHERE place <= 10
UNION ALL SELECT l_suppkey, 11, 'other', CAST(sum(value) AS BIGINT) FROM ranked WHERE place > 10 GROUP BY l_suppkey""")
def _(t):
    rows = t.read("lineitem").select("l_suppkey", F.col("l_orderkey").cast("string").alias("label"), F.expr(_CENTS).alias("value"),
                                     "l_orderkey", "l_linenumber")
    return rank.top_with_other(rows, ["l_suppkey"], "value", "label", 10, "other", ["l_orderkey", "l_linenumber"])


@query("account_values", "D3 D4", ctes(ACCOUNTS) + f""",
newest AS (SELECT o_custkey, max(o_orderdate) AS snapshot_at, arg_max({cents_sql('o_totalprice')}, (o_orderdate, o_orderkey)) AS total,
                  lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS account_id,
                  CASE WHEN o_custkey % 2 = 0 THEN 'pension' END AS account_type FROM orders GROUP BY o_custkey)
SELECT newest.account_id, coalesce(label, account_type, 'unknown') AS account_label,
       coalesce(CASE label WHEN 'ria' THEN '위험자산 일임' WHEN 'isa' THEN 'ISA' WHEN 'brokerage' THEN '일반 위탁' WHEN 'irp' THEN 'IRP 퇴직연금'
                           WHEN 'pension' THEN '연금저축' END, account_type, 'unknown') AS display_name,
       concat(substring(newest.account_id, 1, 2), '****', right(newest.account_id, 2)) AS masked_number, snapshot_at, total AS value_krw
FROM newest LEFT JOIN accounts USING (account_id)""", times="snapshot_at")
def _(t):
    seen = t.read("orders").select(
        F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("account_id"), F.lpad(F.col("o_orderkey").cast("string"), 20, "0").alias("id"),
        F.when(F.col("o_custkey") % 2 == 0, "pension").alias("account_type"), F.col("o_orderdate").alias("snapshot_at"),
        F.expr(cents_sql("o_totalprice")).alias("total_eval_amt"),
    )
    return H.account_values(latest_snapshots(seen), account_dimension(t.accounts()), [])


_ACCOUNTS = f"""
totals AS (SELECT o_custkey AS owner_id, CAST(sum({cents_sql('o_totalprice')}) AS BIGINT) AS total FROM orders GROUP BY o_custkey),
valuesof AS (SELECT owner_id, 'isa' AS account_label, 1000 AS value_krw FROM totals UNION ALL SELECT owner_id, 'brokerage', total FROM totals),
held AS (SELECT owner_id, account_label, CAST(sum(value_krw) AS BIGINT) AS held, {_FIVE} FROM classed GROUP BY owner_id, account_label),
positions AS (SELECT owner_id, account_label, v.value_krw, coalesce(held, 0) AS held, greatest(v.value_krw - coalesce(held, 0), 0) AS residual,
                     coalesce(domestic_direct, 0) AS dd, coalesce(overseas_indirect, 0) AS oi, coalesce(unknown, 0) AS un
              FROM valuesof v LEFT JOIN held USING (owner_id, account_label))"""


@query("residual_cash", "G14", ctes(_BASE, MASTER, OVERRIDES, _CLASSED, _ACCOUNTS) + """
SELECT owner_id, account_label, CAST(residual AS BIGINT) AS value_krw, '국내 예수금/현금성' AS name, 'cash' AS exposure_type
FROM positions WHERE residual > 0""")
def _(t):
    positions = H.account_positions(values(t), classified(t), BY)
    return H.residual_cash_rows(positions, BY).select("owner_id", "account_label", "value_krw", "name", "exposure_type")


def full(t, top_n=10):
    return overview.total_asset_overview(
        values(t), domestic(t), overseas(t), cash(t), rates(t), t.master(), t.overrides(), BY, top_n)


_PCT = "round(CAST({0} AS DOUBLE) / nullif(CAST({1} AS DOUBLE), 0) * 100, 2)"
_SUMMARY = f"""
folded AS (SELECT owner_id, CAST(sum(value_krw) AS BIGINT) AS dom, CAST(sum(held) AS BIGINT) AS held, CAST(sum(residual) AS BIGINT) AS residual, count(*) AS accounts,
                  CAST(sum(dd) AS BIGINT) AS dd, CAST(sum(oi) AS BIGINT) AS oi, CAST(sum(un) AS BIGINT) AS un FROM positions GROUP BY owner_id),
joined AS (SELECT coalesce(f.owner_id, p.owner_id) AS owner_id, coalesce(dom, 0) AS dom, coalesce(held, 0) AS held, coalesce(residual, 0) AS residual,
                  coalesce(accounts, 0) AS accounts, coalesce(dd, 0) AS dd, coalesce(oi, 0) AS oi, coalesce(un, 0) AS un,
                  coalesce(stock, 0) AS stock, coalesce(p.total, 0) AS ototal, coalesce(n, 0) AS n, reported
           FROM folded f FULL JOIN parts p ON p.owner_id = f.owner_id),
summary AS (SELECT owner_id, dom AS domestic_eval_amt_krw, stock AS overseas_stock_eval_amt_krw, CAST(greatest(ototal - stock, 0) AS BIGINT) AS overseas_cash_amt_krw,
       ototal AS overseas_total_asset_amt_krw, dom + ototal AS total_eval_amt_krw, {_PCT.format('dom', 'dom + ototal')} AS domestic_pct,
       {_PCT.format('ototal', 'dom + ototal')} AS overseas_pct, {_PCT.format('stock', 'dom + ototal')} AS overseas_stock_pct,
       {_PCT.format('greatest(ototal - stock, 0)', 'dom + ototal')} AS overseas_cash_pct, dd AS domestic_direct_amt_krw,
       stock AS overseas_direct_amt_krw, oi AS overseas_indirect_amt_krw, CAST(residual + greatest(ototal - stock, 0) AS BIGINT) AS cash_amt_krw,
       un AS unknown_amt_krw, held AS domestic_non_cash_amt_krw, accounts AS account_count, 'ria' AS overseas_account_label, n AS overseas_holdings_count,
       CASE WHEN reported IS NOT NULL THEN 'overseas_deposit.예수금_총계.총자산금액' ELSE 'stock_eval_plus_deposit_cash_fields' END AS total_asset_source
FROM joined)"""
_OVERVIEW = ctes(_BASE, MASTER, OVERRIDES, _CLASSED, _ACCOUNTS, _VALUED, _CASH, _SUMMARY)


@query("total_asset_overview", "G11 E8 J7", _OVERVIEW + "SELECT * FROM summary")
def _(t):
    return full(t).summary


@query("overview_holdings", "I1 G11", _OVERVIEW + """
SELECT owner_id, account_label, symbol, basis_category, exposure_type, quantity, value_krw, value_foreign, currency FROM (
SELECT owner_id, account_label, symbol, 'domestic_account' AS basis_category, exposure_type, quantity, value_krw, CAST(NULL AS DOUBLE) AS value_foreign, 'KRW' AS currency FROM classed
UNION ALL SELECT owner_id, account_label, NULL, 'cash', 'cash', NULL, CAST(residual AS BIGINT), NULL, 'KRW' FROM positions WHERE residual > 0
UNION ALL SELECT owner_id, 'ria', symbol, 'overseas_account', 'overseas_direct', quantity, value_krw, round(value_foreign, 2), currency FROM valued
UNION ALL SELECT owner_id, 'ria', NULL, 'cash', 'cash', NULL, overseas_cash_amt_krw, NULL, 'KRW' FROM summary WHERE overseas_cash_amt_krw > 0) AS h""")
def _(t):
    return full(t).holdings.select("owner_id", "account_label", "symbol", "basis_category", "exposure_type", "quantity", "value_krw",
                                   "value_foreign", "currency")


@query("overview_accounts", "G11 D3", _OVERVIEW + f"""
SELECT owner_id, account_label, upper(account_label) AS label, p.value_krw, {_PCT.format('p.value_krw', 'total_eval_amt_krw')} AS pct
FROM positions p JOIN summary USING (owner_id)
UNION ALL SELECT owner_id, 'ria', '해외자산', overseas_total_asset_amt_krw, {_PCT.format('overseas_total_asset_amt_krw', 'total_eval_amt_krw')} FROM summary""")
def _(t):
    return full(t).accounts


def _chart_rows() -> str:
    rows = [
        ("domestic_vs_overseas", 1, "국내자산", None, "domestic_eval_amt_krw", None),
        ("domestic_vs_overseas", 2, "해외자산", None, "overseas_total_asset_amt_krw", None),
        ("overseas_stock_vs_cash", 1, "해외주식", None, "overseas_stock_eval_amt_krw", "overseas_total_asset_amt_krw"),
        ("overseas_stock_vs_cash", 2, "해외 예수금/현금성", None, "overseas_cash_amt_krw", "overseas_total_asset_amt_krw"),
        ("by_account_basis", 1, "국내계좌 보유자산", None, "domestic_non_cash_amt_krw", None),
        ("by_account_basis", 2, "해외계좌 보유자산", None, "overseas_stock_eval_amt_krw", None),
        ("by_account_basis", 3, "현금성", None, "cash_amt_krw", None),
        ("by_economic_exposure", 1, "국내직접", "domestic_direct", "domestic_direct_amt_krw", None),
        ("by_economic_exposure", 2, "해외직접", "overseas_direct", "overseas_direct_amt_krw", None),
        ("by_economic_exposure", 3, "해외우회투자", "overseas_indirect", "overseas_indirect_amt_krw", None),
        ("by_economic_exposure", 4, "현금성", "cash", "cash_amt_krw", None),
        ("by_economic_exposure", 5, "분류필요", "unknown", "unknown_amt_krw", None),
    ]
    return "\nUNION ALL ".join(
        f"SELECT owner_id, '{chart}' AS chart, {place} AS place, '{label}' AS label, "
        + (f"'{key}'" if key else "CAST(NULL AS VARCHAR)") + f" AS key, CAST({value} AS BIGINT) AS value_krw, "
        + _PCT.format(value, "total_eval_amt_krw") + " AS pct, "
        + (_PCT.format(value, part) if part else "CAST(NULL AS DOUBLE)") + " AS pct_of_part FROM summary"
        for chart, place, label, key, value, part in rows
    )


@query("overview_charts", "G11 E8", _OVERVIEW + _chart_rows())
def _(t):
    return full(t).charts


@query("overview_top_holdings", "H4 G11", ctes(_BASE, MASTER, OVERRIDES, _CLASSED, _ACCOUNTS, _VALUED, _CASH, _SUMMARY, _TOP) + f"""
SELECT owner_id, place, label, value_krw, value_foreign, currency, {_SHARE.format('overseas_stock_eval_amt_krw', 'pct_of_overseas_stock')},
       {_SHARE.format('overseas_total_asset_amt_krw', 'pct_of_overseas_total')}, {_SHARE.format('total_eval_amt_krw', 'pct_of_total')}
FROM listed JOIN summary USING (owner_id)""")
def _(t):
    return full(t, 3).top


@query("overview_inconsistencies", "G15", _OVERVIEW + """
SELECT owner_id, total_eval_amt_krw, overseas_total_asset_amt_krw, overseas_stock_eval_amt_krw, overseas_cash_amt_krw FROM summary
WHERE overseas_total_asset_amt_krw <> overseas_stock_eval_amt_krw + overseas_cash_amt_krw""")
def _(t):
    return overview.inconsistent(full(t).summary).select(
        "owner_id", "total_eval_amt_krw", "overseas_total_asset_amt_krw", "overseas_stock_eval_amt_krw", "overseas_cash_amt_krw")


def _raw(t):
    """The same owners as raw responses: account snapshots with their balance, overseas balances and deposits."""
    def listed(rows, keys, **members):
        item = F.struct(*[F.col(column).cast("string").alias(name) for name, column in members.items()])
        return rows.groupBy(*keys).agg(F.struct(F.collect_list(item).alias("output1")).alias("response"))

    at_home = listed(domestic(t), ["owner_id", "account_label"], pdno="symbol", prdt_name="name", evlu_amt="value_krw",
                     hldg_qty="quantity")
    number = F.concat_ws("-", F.lit("acct"), "owner_id", "account_label").alias("account_id")
    latest = values(t).join(at_home, ["owner_id", "account_label"], "left").select(
        number, F.col("account_label").alias("account_type"), F.lit("2024-01-31 09:00:00").cast("timestamp_ntz").alias("snapshot_at"),
        F.col("value_krw").alias("total_eval_amt"), F.to_json("response").alias("balance_data"))
    # An older snapshot of every account, with another value and nothing held.
    older = values(t).select(
        number, F.col("account_label").alias("account_type"), F.lit("2024-01-30 09:00:00").cast("timestamp_ntz").alias("snapshot_at"),
        (F.col("value_krw") + 1).alias("total_eval_amt"), F.lit('{"output1":[]}').alias("balance_data"))
    away = listed(overseas(t), ["owner_id"], ovrs_pdno="symbol", ovrs_item_name="name", tr_crcy_cd="currency",
                  ovrs_cblc_qty="quantity", ovrs_stck_evlu_amt="value_foreign").select(
        "owner_id", F.lit("ria").alias("account_label"), F.to_json(F.struct(F.col("response").alias("NASD"))).alias("balance_data"))
    pairs = rates(t).groupBy("owner_id").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat("currency", F.lit("/KRW")), F.col("rate").cast("string")))).alias("pairs"))
    deposits = cash(t).join(pairs, "owner_id", "left").select("owner_id", "account_label", F.to_json(F.struct(
        F.struct(F.col("total_asset_amt_krw").cast("string").alias("총자산금액"),
                 F.col("cash_from_fields_amt_krw").cast("string").alias("총예수금액")).alias("예수금_총계"),
        F.coalesce("pairs", F.create_map().cast("map<string,string>")).alias("적용환율"))).alias("payload"))
    return latest.unionByName(older), away, deposits


def _owner(df):
    return df.withColumn("owner_id", F.split("account_id", "-")[1].cast("bigint"))


def _end_to_end(t):
    """Raw responses are stored, read back, valued and classified; the overview is stored, its holdings with it.

    What several results need is written once, and goes when nothing reads it any more: the deposits, the accounts'
    values, and the classified and valued holdings, positions and summary. Values are found without the responses."""
    root, paths = scratch_path(t.spark, "tables"), {}

    def keep(df, name):
        paths[name] = scratch_path(t.spark, name)
        return materialize(df, paths[name], tables.COMPRESSION)

    def drop(*names):
        for name in names:
            drop_scratch(t.spark, paths.pop(name))

    snapshots, away, deposits = _raw(t)
    tables.append(append.portfolio_snapshots(snapshots), root, "portfolio_snapshots")
    stored = tables.read_table(t.spark, root, "portfolio_snapshots").drop("month")
    latest, bare = _owner(latest_snapshots(stored)), _owner(latest_snapshots(stored.drop("balance_data")))
    accounts = bare.select("account_id", F.col("account_type").alias("label"),
                           F.upper("account_type").alias("display_name"), F.lit(None).cast("string").alias("masked_number"))
    worth = keep(H.account_values(bare, accounts, BY), "worth")
    held = keep(balances.domestic_holdings(latest.select(
        "owner_id", "account_id", F.col("account_type").alias("account_label"), "balance_data")), "held")
    abroad = keep(balances.overseas_holdings(away), "abroad")
    deposits = keep(deposits, "deposits")
    shaped = balances.read_reshaped_deposit(deposits)
    result = overview.total_asset_overview(
        worth, held, abroad, balances.cash_summary(shaped), balances.fx_rates(shaped, BY), t.master(), t.overrides(), BY,
        deposits=deposits.select("owner_id", F.col("payload").alias("deposit_data")), keep=keep)
    drop("held", "abroad")
    at = F.lit("2024-01-31 10:00:00").cast("timestamp_ntz")
    # Rows stamped with one time lie in one month.
    rows = append.overview_snapshots(overview.documents(result, BY).withColumn("id", F.concat(F.lit("o"), "owner_id")), at)
    tables.append(rows, root, "asset_overview_snapshots", 1)
    tables.append(append.holding_snapshots(result.holdings.withColumn(
        "overview_snapshot_id", F.concat(F.lit("o"), "owner_id")), at), root, "asset_holding_snapshots", 1)
    drop(*paths.copy())
    return root


@query("stored_overviews_from_raw", "G11 B7 B9 A4 A5 A6 D4", _OVERVIEW + """
SELECT owner_id, domestic_eval_amt_krw, overseas_stock_eval_amt_krw, overseas_cash_amt_krw, overseas_total_asset_amt_krw,
       total_eval_amt_krw, domestic_pct, overseas_pct, domestic_direct_amt_krw, overseas_direct_amt_krw,
       overseas_indirect_amt_krw, cash_amt_krw, unknown_amt_krw, unknown_amt_krw AS unknown_in_json,
       total_asset_source AS source_in_json, 12 AS chart_rows, (SELECT count(*) + 1 FROM positions p WHERE p.owner_id = summary.owner_id) AS account_rows,
       (SELECT count(*) FROM classed c WHERE c.owner_id = summary.owner_id AND warning IS NOT NULL) AS warning_rows
FROM summary""")
def _(t):
    stored = tables.read_table(t.spark, _end_to_end(t), "asset_overview_snapshots")

    def rows(column, path):
        return F.coalesce(F.size(F.from_json(F.get_json_object(column, path), "array<string>")), F.lit(0))

    return stored.select(
        F.substring("id", 2, 30).cast("bigint").alias("owner_id"), "domestic_eval_amt_krw", "overseas_stock_eval_amt_krw",
        "overseas_cash_amt_krw", "overseas_total_asset_amt_krw", "total_eval_amt_krw", "domestic_pct", "overseas_pct",
        "domestic_direct_amt_krw", "overseas_direct_amt_krw", "overseas_indirect_amt_krw", "cash_amt_krw", "unknown_amt_krw",
        F.get_json_object("classification_summary", "$.amounts.unknown_amt_krw").cast("bigint").alias("unknown_in_json"),
        F.get_json_object("overview_data", "$.overseas.total_asset_source").alias("source_in_json"),
        rows("overview_data", "$.charts").alias("chart_rows"), rows("overview_data", "$.domestic.accounts").cast("bigint").alias("account_rows"),
        rows("classification_summary", "$.warnings").cast("bigint").alias("warning_rows"),
    )


@query("stored_holdings_from_raw", "B10 I1 D2 D5", _OVERVIEW + """
SELECT owner_id, account_label, symbol, basis_category, exposure_type, quantity, value_krw, value_foreign, currency, has_deposit FROM (
SELECT owner_id, account_label, symbol, 'domestic_account' AS basis_category, exposure_type, quantity, value_krw, CAST(NULL AS DOUBLE) AS value_foreign, 'KRW' AS currency, false AS has_deposit FROM classed
UNION ALL SELECT owner_id, account_label, NULL, 'cash', 'cash', NULL, CAST(residual AS BIGINT), NULL, 'KRW', false FROM positions WHERE residual > 0
UNION ALL SELECT owner_id, 'ria', symbol, 'overseas_account', 'overseas_direct', quantity, value_krw, round(value_foreign, 2), currency, false FROM valued
UNION ALL SELECT owner_id, 'ria', NULL, 'cash', 'cash', NULL, overseas_cash_amt_krw, NULL, 'KRW', true FROM summary WHERE overseas_cash_amt_krw > 0) AS h""")
def _(t):
    stored = tables.read_table(t.spark, _end_to_end(t), "asset_holding_snapshots")
    cash_abroad = (F.col("basis_category") == "cash") & (F.col("market") == "FX")
    return stored.select(
        F.substring("overview_snapshot_id", 2, 30).cast("bigint").alias("owner_id"), "account_label", "symbol", "basis_category",
        "exposure_type", "quantity", "value_krw", "value_foreign", "currency",
        (cash_abroad & F.col("raw_data").contains("적용환율")).alias("has_deposit"))
