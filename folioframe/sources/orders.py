"""Order-list responses to canonical order rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import numbers, payload, text, variants

# Canonical column -> candidate member names, first filled one wins.
TEXT_FIELDS = {
    "original_order_no": ("orgn_odno",),
    "symbol": ("pdno",),
    "symbol_name": ("prdt_name", "item_name", "hts_kor_isnm"),
    "side_code": ("sll_buy_dvsn_cd",),
    "side_name": ("sll_buy_dvsn_cd_name",),
    "order_type_code": ("ord_dvsn_cd",),
    "order_type_name": ("ord_dvsn_name",),
    "order_time": ("ord_tmd",),
    "condition_name": ("ccld_cndt_name",),
    "exchange_id_code": ("excg_id_dvsn_cd", "excg_id_dvsn_Cd", "excg_dvsn_cd"),
    "order_orgno": ("ord_orgno",),
}
NUMBER_FIELDS = {
    "order_qty": ("ord_qty",),
    "total_order_qty": ("tot_ord_qty", "ord_qty"),
    "order_price": ("ord_unpr",),
    "avg_price": ("avg_prvs", "pchs_avg_pric"),
    "filled_qty": ("tot_ccld_qty", "ccld_qty"),
    "filled_amount": ("tot_ccld_amt",),
    "pending_qty": ("rmn_qty",),
    "cancel_confirm_qty": ("cnc_cfrm_qty",),
    "rejected_qty": ("rjct_qty",),
}

_IDENTITY = ("account_id", "account_product_code", "account_type")
NUMBER, DATE, BRANCH, CANCELLED = "odno", "ord_dt", "ord_gno_brno", "cncl_yn"
LISTED = "_listed"
_NAMES = (NUMBER, DATE, BRANCH, CANCELLED,
          *[name for fields in (TEXT_FIELDS, NUMBER_FIELDS) for names in fields.values() for name in names])
ORDER_MEMBERS, PARSED_MEMBERS = payload.all_spellings(*_NAMES), variants.all_spellings(*_NAMES)


def order_texts(response: Column) -> Column:
    """The order list of a response, as JSON texts."""
    return payload.items(response, "output1")


def order_day(members: payload.Members | variants.Members, fallback: Column, row: Column | None = None) -> Column:
    """Date of an order row: its own, else the fallback, with dashes ignored."""
    own = members.pick(DATE) if row is None else members.pick(DATE, row=row)
    return text.parse_day_or_iso(F.coalesce(own, fallback))


def _typed(rows: DataFrame, row, raw: Column, source: Column) -> DataFrame:
    """Canonical columns of exploded orders; `row` reads their members."""
    def texts(fields: dict[str, tuple[str, ...]]) -> list[Column]:
        return [row.pick(*names).alias(column) for column, names in fields.items()]

    return rows.select(
        *_IDENTITY,
        order_day(row, F.col("fallback_date")).alias("order_date"),
        F.coalesce(row.pick(BRANCH), F.lit("")).alias("order_branch_no"),
        row.pick(NUMBER).alias("order_no"),
        *texts(TEXT_FIELDS),
        *[numbers.strict_int(row.pick(*names)).alias(column) for column, names in NUMBER_FIELDS.items()],
        text.yes_no(row.pick(CANCELLED)).alias("is_cancelled"),
        source.alias("last_source"),
        F.col("observation_id").alias("last_order_history_id"),
        raw.alias("raw_data"),
        F.col("fetched_at").alias("seen_at"),
        F.col("_place").alias("place"),
    )


def _candidates(responses: DataFrame, source: Column) -> DataFrame:
    listed = F.col(LISTED) if LISTED in responses.columns else ORDER_MEMBERS.parse_all(order_texts(F.col("payload")))
    return _typed(ORDER_MEMBERS.explode_parsed(responses, listed), ORDER_MEMBERS, F.col("_text"), source)


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    usable = F.col("order_no").isNotNull() & F.col("order_date").isNotNull()
    return rows.filter(usable), rows.filter(~usable)


def order_rows_of_documents(documents: DataFrame, source: str = "batch") -> tuple[DataFrame, DataFrame]:
    """`order_rows` of responses that are stored parsed, as VARIANT in `doc`: no text is parsed."""
    rows = PARSED_MEMBERS.explode(documents, F.col("doc"), "output1")
    return _split(_typed(rows, PARSED_MEMBERS, F.to_json("_value"), F.lit(source)))


def order_rows(responses: DataFrame, source: str = "batch") -> tuple[DataFrame, DataFrame]:
    """Canonical rows and rejects of order-list responses.

    `responses` holds account_id, account_product_code, account_type, fallback_date (`YYYYMMDD`),
    observation_id, fetched_at and payload. A row needs an order number and a date, its own or the fallback;
    one without goes to the rejects. `seen_at` and `place` (position in the response) order the rows of one
    order for `merge.upsert`. Responses that `parse_lists` has read carry their lists and are not parsed again.
    """
    return _split(_candidates(responses, F.lit(source)))


def order_count(response: Column) -> Column:
    """Length of the order list, 0 when it is not a list."""
    return payload.once(order_texts(response), payload.length)


def parse_lists(responses: DataFrame) -> DataFrame:
    """`responses` with their order lists parsed, once for all that is asked of them: `_listed`, and `order_count`.

    To be stored before it is used several times."""
    texts = responses.withColumn("_texts", order_texts(F.col("payload")))
    return texts.withColumns({LISTED: ORDER_MEMBERS.parse_all(F.col("_texts")), "order_count": payload.length(F.col("_texts"))}).drop("_texts")


def storable_count(response: Column, fallback: Column) -> Column:
    """How many rows of a response have an order number and a date, told without exploding it."""
    return storable_in(ORDER_MEMBERS.parse_all(order_texts(response)), fallback)


def storable_in(listed: Column, fallback: Column) -> Column:
    """The same of a list that is parsed already."""
    kept = F.filter(listed, lambda entry: ORDER_MEMBERS.pick(NUMBER, row=entry["row"]).isNotNull()
                    & order_day(ORDER_MEMBERS, fallback, entry["row"]).isNotNull())
    return payload.once(kept, payload.length)


def display_rows(orders: DataFrame) -> DataFrame:
    """The read projection: side and type by name or else code, compact date, blank branch as NULL."""
    return orders.select(
        "order_no",
        text.blank_to_null(F.col("order_branch_no")).alias("order_branch_no"),
        "original_order_no", "symbol", "symbol_name",
        F.date_format("order_date", "yyyyMMdd").alias("order_date"),
        "order_time",
        text.first_filled(F.col("side_name"), F.col("side_code")).alias("side"),
        "side_code",
        text.first_filled(F.col("order_type_name"), F.col("order_type_code")).alias("order_type"),
        "order_type_code",
        *NUMBER_FIELDS,
        "is_cancelled", "condition_name", "exchange_id_code", "first_seen_at", "last_seen_at", "last_source",
        "last_order_history_id",
        F.col("raw_data").alias("raw"),
    )
