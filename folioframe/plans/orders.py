"""Order history: collection from raw responses, replay, and reads served from what is stored."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import payload
from folioframe.operators import merge, reads
from folioframe.plans.gate import collection_gate
from folioframe.session import materialize, scratch_path
from folioframe.sources import orders as source

BATCH_SOURCE, REPLAY_SOURCE = "batch", "order_history_backfill"
DOMESTIC = "domestic"

_ACCOUNT = ["account_id", "account_product_code"]
_SPAN = [*_ACCOUNT, "market_type", "start_date", "end_date"]


class Collection(NamedTuple):
    """What one collection run stores and reports."""

    observations: DataFrame
    orders: DataFrame
    rejects: DataFrame
    outcomes: DataFrame


def collect(responses: DataFrame, calendar: DataFrame, close_grace_minutes: int = 5) -> Collection:
    """One day's order-list responses of all accounts.

    `responses` holds id, account_id, account_product_code, account_type, market, trade_date, now (UTC,
    without zone) and payload. Responses the gate holds back are reported as skipped. One that is not a JSON
    object is reported as an error; the others are stored whatever happens to it. Every response is parsed once:
    gated and parsed responses are written to the scratch folder, and the four results read from there.
    """
    gated = collection_gate(responses, calendar, close_grace_minutes)
    readable = payload.members(F.col("payload")).isNotNull()
    state = F.when(F.col("status") == "skipped", "skipped").when(readable, "ok").otherwise("error")
    checked = gated.withColumn("outcome", state).withColumn("fallback_date", F.date_format("trade_date", "yyyyMMdd"))
    carried = ["id", *_ACCOUNT, "account_type", "trade_date", "now", "reason", "outcome", "fallback_date", "payload"]
    parsed = source.parse_lists(checked.filter(F.col("outcome") == "ok").select(*carried))
    stored = materialize(parsed.unionByName(checked.filter(F.col("outcome") != "ok").select(*carried), allowMissingColumns=True),
                         scratch_path(responses.sparkSession, "collected"))
    good = stored.filter(F.col("outcome") == "ok")

    observations = good.select(
        "id", *_ACCOUNT, "account_type", F.lit(DOMESTIC).alias("market_type"),
        F.col("trade_date").alias("start_date"), F.col("trade_date").alias("end_date"),
        F.col("now").alias("fetched_at"), F.col("payload").alias("data"),
    )
    orders, rejects = source.order_rows(good.select(
        *_ACCOUNT, "account_type", "fallback_date", F.col("id").alias("observation_id"), F.col("now").alias("fetched_at"),
        source.LISTED), BATCH_SOURCE)
    ok = F.col("outcome") == "ok"
    outcomes = stored.select(
        "id", *_ACCOUNT, "trade_date", F.col("outcome").alias("status"), "reason",
        F.when(ok, F.col("order_count")).alias("order_count"),
        F.when(ok, source.storable_in(F.col(source.LISTED), F.col("fallback_date"))).alias("canonical_write_count"),
        F.when(ok, "saved").alias("history_status"),
    )
    return Collection(observations, orders, rejects, outcomes)


def _as_responses(observations: DataFrame) -> DataFrame:
    """Stored observations in the shape of responses; rows without a date fall back to the range's start."""
    return observations.select(
        *_ACCOUNT, "account_type", F.date_format("start_date", "yyyyMMdd").alias("fallback_date"),
        F.col("id").alias("observation_id"), "fetched_at", F.col("data").alias("payload"),
    )


def _per_day(spans: DataFrame) -> DataFrame:
    """One row per day of each range, so that orders meet ranges by equality and no pairs are tried. A range that
    ends before it starts has no days."""
    return spans.filter("start_date <= end_date").withColumn("order_date", F.explode(F.sequence("start_date", "end_date")))


def serve(requests: DataFrame, observations: DataFrame, canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers from what is stored: orders of the covered requests, and the coverage of all.

    `requests` holds account_id, account_product_code, market_type, start_date and end_date. A request is
    covered when an observation of exactly its range is stored; coverage is `ok` or `cache_miss`, with the
    observation used. Orders carry the request's range.
    """
    found = reads.latest_observations(observations, requests, payload=False).select(
        *_SPAN, F.col("id").alias("snapshot_id"), "fetched_at")
    coverage = requests.select(*_SPAN).distinct().join(found, _SPAN, "left").withColumn(
        "status", F.when(F.col("snapshot_id").isNotNull(), "ok").otherwise("cache_miss")
    )
    covered = _per_day(found.select(*_SPAN))
    rows = covered.join(canonical, [*_ACCOUNT, "order_date"])
    return rows, coverage


def history(canonical: DataFrame, observations: DataFrame, account_id: str, product_code: str,
            start: reads.Day, end: reads.Day, symbol: str = "") -> DataFrame:
    """Orders of one account and range in the read projection, newest first; none if the range is not covered."""
    exact = observations.filter(
        (F.col("account_id") == account_id) & (F.col("market_type") == DOMESTIC)
        & (F.col("start_date") == F.lit(reads.as_day(start))) & (F.col("end_date") == F.lit(reads.as_day(end)))
        & (F.col("account_product_code").isNull() | (F.col("account_product_code") == product_code))
    ).select("account_id").limit(1)
    rows = reads.orders(canonical, account_id, product_code, start, end, symbol)
    return source.display_rows(reads.newest_first(rows.join(exact, "account_id", "left_semi")))


def missing_from_canonical(requests: DataFrame, observations: DataFrame, canonical: DataFrame) -> DataFrame:
    """Observations that serve a request and list orders of which none is stored in its range."""
    found = reads.latest_observations(observations, requests, payload=False)
    # Ranges are told apart before payloads are fetched, so that those of ranges with stored orders never travel.
    stored = _per_day(found.select(*_SPAN)).join(
        canonical.select(*_ACCOUNT, "order_date"), [*_ACCOUNT, "order_date"], "left_semi"
    ).select(*_SPAN).distinct()
    lost = reads.with_payloads(found.join(stored, _SPAN, "left_anti"), observations)
    return lost.filter(source.order_count(F.col("data")) > 0)


def replay(requests: DataFrame, observations: DataFrame, canonical: DataFrame, now: Column) -> DataFrame:
    """Canonical orders after writing the rows of observations that never reached them."""
    rows, _ = source.order_rows(_as_responses(missing_from_canonical(requests, observations, canonical)),
                                REPLAY_SOURCE)
    return merge.upsert_orders(canonical, rows, now)
