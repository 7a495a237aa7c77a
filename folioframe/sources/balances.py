"""Balance and deposit responses: totals, holdings, cash and exchange rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import numbers, payload, text, variants

# Total-value members in order of preference.
TOTAL_FIELDS = (
    "tot_evlu_amt", "scts_evlu_amt", "tot_asst_amt", "evlu_amt_smtl_amt", "dnca_tot_amt", "dnca_tota",
)

# Reshaped deposit members and the raw members they come from.
DEPOSIT_TOTALS = {
    "예수금액": "dncl_amt",
    "총예수금액": "tot_dncl_amt",
    "외화예수금액": "frcr_dncl_amt_2",
    "외화사용가능금액": "frcr_use_psbl_amt",
    "인출가능총금액": "wdrw_psbl_tot_amt",
    "총자산금액": "tot_asst_amt",
    "CMA평가금액": "cma_evlu_amt",
}
DEPOSIT_PAIRS = {
    "USD/KRW": "usd_frst_bltn_exrt",
    "HKD/KRW": "hkd_frst_bltn_exrt",
    "JPY/KRW": "jpy_frst_bltn_exrt",
    "CNY/KRW": "cny_frst_bltn_exrt",
}
DEPOSIT_LIST, DEPOSIT_TOTAL, DEPOSIT_RATES = "통화별_잔고", "예수금_총계", "적용환율"


def total_value(balance: Column) -> Column:
    """Total evaluated amount of a balance response: the first filled total member, as a whole number.

    `output2` may be an object or a list, of which the first element counts. A filled member that is not a
    number gives NULL; later members are not tried.
    """
    head = payload.once(F.from_json(balance, "output2 STRING")["output2"], lambda text: F.when(
        text.startswith("["), F.get(F.from_json(text, "ARRAY<STRING>"), F.lit(0))
    ).otherwise(text))
    row = payload.Members(typed=TOTAL_FIELDS)
    return numbers.lenient_int(payload.once(row.parse(head), lambda parsed: F.coalesce(*[
        row.nonzero(name, parsed) for name in TOTAL_FIELDS
    ])))


def reshape_deposit(responses: DataFrame) -> DataFrame:
    """`payload` of present-balance responses to `currency_rows`, `totals` and `pair_rates` columns.

    `currency_rows` is the list of per-currency objects as JSON texts, `totals` a map of the renamed totals,
    `pair_rates` a map of rate by currency pair; each is NULL where the response lacks its part.
    """
    totals = F.col("_parts.output3")

    def renamed(names: dict[str, str]) -> Column:
        entries = [item for new, old in names.items() for item in (F.lit(new), F.try_element_at(totals, F.lit(old)))]
        return F.when(totals.isNotNull(), F.create_map(*entries))

    carried = [name for name in responses.columns if name != "payload"]
    parts = payload.parts(F.col("payload"), lists=("output2",), maps=("output3",))
    return responses.withColumn("_parts", parts).select(
        *carried,
        F.col("_parts.output2").alias("currency_rows"),
        renamed(DEPOSIT_TOTALS).alias("totals"),
        renamed(DEPOSIT_PAIRS).alias("pair_rates"),
    )


def read_reshaped_deposit(deposits: DataFrame) -> DataFrame:
    """The same three columns from already reshaped deposits, stored as JSON text in `payload`."""
    carried = [name for name in deposits.columns if name != "payload"]
    parts = payload.parts(F.col("payload"), lists=(DEPOSIT_LIST,), maps=(DEPOSIT_TOTAL, DEPOSIT_RATES))
    return deposits.withColumn("_parts", parts).select(
        *carried,
        F.col("_parts")[DEPOSIT_LIST].alias("currency_rows"),
        F.col("_parts")[DEPOSIT_TOTAL].alias("totals"),
        F.col("_parts")[DEPOSIT_RATES].alias("pair_rates"),
    )


def pair_rate_rows(reshaped: DataFrame) -> DataFrame:
    """One `(pair, rate)` text row per currency pair."""
    carried = [name for name in reshaped.columns if name not in ("currency_rows", "totals", "pair_rates")]
    return reshaped.select(*carried, F.explode("pair_rates").alias("pair", "rate"))


_HOLDING = ("pdno", "prdt_name", "hldg_qty", "evlu_amt")


def _held(entries: Column, typed, wanted) -> Column:
    """Holdings of a list of parsed objects, those `wanted`, typed inside the array: as columns after the explode the
    numbers are parsed twice, in the filter and in the projection, by more code than the JVM compiles as one method."""
    return F.filter(F.transform(entries, lambda entry: F.struct(*typed(entry))), wanted)


def _domestic(entries: Column, member, raw=None) -> Column:
    """`member` takes a member of an entry, `raw` the text of the whole object."""
    return _held(entries, lambda entry: [
        F.trim(member("pdno", entry)).alias("symbol"),
        F.trim(F.coalesce(member("prdt_name", entry), F.lit(""))).alias("name"),
        numbers.parse_number(member("hldg_qty", entry)).alias("quantity"),
        numbers.parse_int(member("evlu_amt", entry)).alias("value_krw"),
        *([raw(entry).alias("raw_data")] if raw else []),
    ], lambda held: (held["symbol"] != "") & (held["value_krw"] > 0))


def domestic_holdings(snapshots: DataFrame, balance: str = "balance_data") -> DataFrame:
    """Holdings of domestic balance responses: symbol, name, quantity, value and the raw object.

    Columns of `snapshots` other than the response are carried. Blank symbols and values of 0 or less go.
    """
    row = payload.Members(*_HOLDING)
    carried = [name for name in snapshots.columns if name != balance]
    entries = row.parse_all(payload.items(F.col(balance), "output1"))
    return snapshots.select(*carried, F.inline(_domestic(
        entries, lambda name, entry: row.get(name, row=entry["row"]), lambda entry: entry["text"])))


def domestic_holdings_of_documents(documents: DataFrame, doc: str = "doc", raw: bool = True) -> DataFrame:
    """The same of balance responses that are stored parsed, as VARIANT: no text is parsed. Without `raw` the objects
    themselves are not taken from the response, only their members."""
    row = variants.Members(*_HOLDING)
    carried = [name for name in documents.columns if name != doc]
    if raw:
        held = _domestic(row.read_all(F.col(doc), "output1"), lambda name, entry: row.get(name, row=entry["row"]),
                         lambda entry: F.to_json(entry["value"]))
    else:
        held = _domestic(row.rows(F.col(doc), "output1"), lambda name, entry: row.get(name, row=entry))
    return documents.select(*carried, F.inline(held))


def overseas_holdings(balances: DataFrame, balance: str = "balance_data") -> DataFrame:
    """Holdings of overseas balance responses, a map of exchange to response.

    The currency is the response's own, else the exchange's. Values of 0 or less, or missing, go.
    """
    row = payload.Members(
        "ovrs_pdno", "ovrs_item_name", "tr_crcy_cd", "ovrs_cblc_qty", "ord_psbl_qty", "ovrs_stck_evlu_amt",
        "frcr_evlu_amt2", "frcr_evlu_pfls_amt", "evlu_pfls_rt",
    )
    carried = [name for name in balances.columns if name != balance]
    by_exchange = balances.select(
        *carried, F.explode(payload.members(F.col(balance))).alias("exchange", "_response")
    ).filter(F.col("_response").startswith("{"))

    def typed(entry: Column) -> list[Column]:
        def member(name: str) -> Column:
            return row.get(name, row=entry["row"])

        def number(*names: str) -> Column:
            return numbers.first_number(*[member(name) for name in names])

        return [
            member("ovrs_pdno").alias("symbol"),
            member("ovrs_item_name").alias("name"),
            member("tr_crcy_cd").alias("_currency"),
            number("ovrs_cblc_qty", "ord_psbl_qty").alias("quantity"),
            number("ovrs_stck_evlu_amt", "frcr_evlu_amt2").alias("value_foreign"),
            number("frcr_evlu_pfls_amt").alias("profit_foreign"),
            number("evlu_pfls_rt").alias("profit_rate_pct"),
            entry["text"].alias("raw_data"),
        ]

    entries = row.parse_all(payload.items(F.col("_response"), "output1"))
    held = by_exchange.select(*carried, "exchange", F.inline(_held(entries, typed, lambda held: held["value_foreign"] > 0)))
    currency = F.coalesce("_currency", text.exchange_currency(F.col("exchange"))).alias("currency")
    return held.select(*carried, "exchange", "symbol", "name", currency, "quantity", "value_foreign", "profit_foreign",
                       "profit_rate_pct", "raw_data")


def fx_rates(reshaped: DataFrame, by: list[str]) -> DataFrame:
    """One KRW rate per `by` and currency.

    A `X/KRW` pair with a readable rate wins; the per-currency list fills the gaps, its first row first.
    """
    pair = F.split(F.col("pair"), "/", 2)
    from_pairs = reshaped.select(*by, F.explode("pair_rates").alias("pair", "rate")).filter(
        F.col("pair").contains("/") & (pair[1] == "KRW")
    ).select(*by, pair[0].alias("currency"), numbers.parse_number(F.col("rate")).alias("rate"),
             F.lit(-1).alias("_place"))
    row = payload.Members("crcy_cd", "frst_bltn_exrt")
    from_list = row.explode(reshaped.select(*by, "currency_rows"), F.col("currency_rows")).select(
        *by,
        row.get("crcy_cd").alias("currency"),
        numbers.parse_number(row.get("frst_bltn_exrt")).alias("rate"),
        "_place",
    )
    usable = from_pairs.unionByName(from_list).filter(
        F.col("currency").isNotNull() & F.col("rate").isNotNull()
    )
    # Few rows per key and all fixed width, so this stays a hash aggregate with a map-side combine.
    return usable.groupBy(*by, "currency").agg(F.min_by("rate", "_place").alias("rate"))


def cash_rows(reshaped: DataFrame) -> DataFrame:
    """One row per currency of the deposit: balances in that currency, their KRW value and the rate."""
    row = payload.Members("crcy_cd", "frcr_dncl_amt_2", "frcr_drwg_psbl_amt_1", "frcr_evlu_amt2", "frst_bltn_exrt")
    carried = [name for name in reshaped.columns if name not in ("currency_rows", "totals", "pair_rates")]
    return row.explode(reshaped, F.col("currency_rows")).select(
        *carried,
        row.get("crcy_cd").alias("currency"),
        numbers.parse_number(row.get("frcr_dncl_amt_2")).alias("cash_foreign"),
        numbers.parse_number(row.get("frcr_drwg_psbl_amt_1")).alias("withdrawable_foreign"),
        numbers.parse_int(row.get("frcr_evlu_amt2")).alias("cash_krw"),
        numbers.parse_number(row.get("frst_bltn_exrt")).alias("fx_rate"),
    )


def cash_summary(reshaped: DataFrame) -> DataFrame:
    """Deposit totals as whole numbers, and total cash: its own field, else the sum of the two parts."""
    def total(name: str) -> Column:
        return numbers.parse_int(F.try_element_at("totals", F.lit(name)))

    carried = [name for name in reshaped.columns if name not in ("currency_rows", "totals", "pair_rates")]
    amounts = reshaped.select(
        *carried,
        total("총자산금액").alias("total_asset_amt_krw"),
        total("총예수금액").alias("total_cash_amt_krw"),
        total("외화사용가능금액").alias("foreign_cash_amt_krw"),
        total("예수금액").alias("krw_cash_amt_krw"),
    )
    parts = F.coalesce("foreign_cash_amt_krw", F.lit(0)) + F.coalesce("krw_cash_amt_krw", F.lit(0))
    return amounts.withColumn("cash_from_fields_amt_krw", F.coalesce("total_cash_amt_krw", parts))
