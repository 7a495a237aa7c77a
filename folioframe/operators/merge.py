"""Keyed merges: insert if absent, overwrite, and last write wins.

Input order does not exist in Spark, so each merge takes the columns that order its input. Copies of a key
are reduced by aggregates that combine on the map side before the shuffle: a key observed in a third of the
rows costs one row per input task, and after it every key is unique, so no join here can be skewed by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_bad(rows: DataFrame, *required: str) -> tuple[DataFrame, DataFrame]:
    """Rows with all of the columns, and the rejects."""
    good = F.lit(True)
    for name in required:
        good = good & F.col(name).isNotNull()
    return rows.filter(good), rows.filter(~good)


def one_per_key(rows: DataFrame, keys: tuple[str, ...], order: list[str], keep: str = "last") -> DataFrame:
    """The first or last row of each key, in the order of the given columns."""
    pick = F.max_by if keep == "last" else F.min_by
    rest = [name for name in rows.columns if name not in keys]
    return rows.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row")).select(
        *keys, "_row.*"
    )


def insert_absent(target: DataFrame, incoming: DataFrame, keys: tuple[str, ...], order: list[str]) -> DataFrame:
    """The incoming rows to append: the first of each key not in `target`. Rows with a NULL in the key are
    rejects (see `split_bad`) and left out: they match nothing, and would be stored again at every run."""
    fresh = one_per_key(split_bad(incoming, *keys)[0], keys, order, keep="first")
    return fresh.join(target.select(*keys), list(keys), "left_anti")


def upsert(target: DataFrame, incoming: DataFrame, keys: tuple[str, ...], order: list[str], now: Column,
           touched: str, created: str | None = None, observed: dict[str, str] | None = None) -> DataFrame:
    """`target` with the last incoming row of each key written over it, NULLs included.

    Columns the input lacks count as NULL; rows with a NULL in the key are rejects and left out. `touched` is set to
    `now` on written rows. `created`, if given, is `now` for new keys and kept for old ones. `observed` names columns
    of `target` that hold the order columns of the stored row: with it a row is written over only by one that is not
    older, so merges may come in any order. The result has the columns of `target`.
    """
    incoming = split_bad(incoming, *keys)[0]
    if observed:
        incoming = incoming.withColumns({name: F.col(source) for name, source in observed.items()})
    values = [name for name in target.columns if name not in (*keys, touched, created)]
    types = {name: target.schema[name].dataType for name in (*keys, *values)}
    given = {name: F.col(name) for name in incoming.columns}
    typed = incoming.select(*[
        given.get(name, F.lit(None)).cast(types[name]).alias(name) if name in types else given[name]
        for name in dict.fromkeys([*keys, *values, *order])
    ])
    # The aggregate leaves the input partitioned by the keys, so the join moves the target alone.
    newest = one_per_key(typed, keys, order).select(*keys, F.struct(*values).alias("_written"))
    stamps = [name for name in (touched, created) if name]
    kept = target.select(*keys, F.struct(*values).alias("_kept"), *stamps)
    written = F.col("_written").isNotNull()
    if observed:
        # NULL orders before all times; a target row without one was stored before times were kept.
        times = [F.struct(*[F.col(f"{side}.{name}") for name in observed]) for side in ("_written", "_kept")]
        written = written & (F.col("_kept").isNull() | (times[0] >= times[1]))
    stamped = {touched: F.when(written, now).otherwise(F.col(touched))}
    if created:
        stamped[created] = F.when(F.col("_kept").isNull(), now).otherwise(F.col(created))
    merged = kept.join(newest, list(keys), "full_outer")
    row = F.when(written, F.col("_written")).otherwise(F.col("_kept")).alias("_row")
    return merged.select(*keys, row, *[value.alias(name) for name, value in stamped.items()]).select(
        *keys, "_row.*", *stamps
    ).select(*target.columns)


def insert_prices(target: DataFrame, incoming: DataFrame, now: Column, order: list[str]) -> DataFrame:
    """New price rows: keys already stored, adjusted or not, are left alone."""
    fresh = insert_absent(target, incoming, ("symbol", "exchange", "date"), order)
    return fresh.withColumns({"adjusted": F.lit(False), "created_at": now}).select(*target.columns)


def overwrite_adjusted(target: DataFrame, incoming: DataFrame, now: Column, order: list[str]) -> DataFrame:
    """Stored prices with adjusted rows written over them and marked; the time of first storing is kept."""
    rows = incoming.withColumn("adjusted", F.lit(True))
    stamped = target.withColumn("_touched", F.col("created_at"))
    merged = upsert(stamped, rows, ("symbol", "exchange", "date"), order, now, "_touched", "created_at")
    return merged.select(*target.columns)


def insert_rates(target: DataFrame, incoming: DataFrame, now: Column, order: list[str]) -> DataFrame:
    """New exchange rates; the period is part of the key and currencies are compared in upper case."""
    rows = incoming.withColumn("currency", F.upper("currency"))
    fresh = insert_absent(target, rows, ("currency", "date", "period"), order)
    return fresh.withColumn("created_at", now).select(*target.columns)


def upsert_orders(target: DataFrame, incoming: DataFrame, now: Column,
                  order: tuple[str, ...] = ("seen_at", "place")) -> DataFrame:
    """Canonical orders after new observations: the latest one wins, the first sighting is remembered.

    The order columns of an observation are stored with the row, if it has columns for them, so an observation that
    comes late does not write over a newer one.
    """
    keys = ("account_id", "account_product_code", "order_date", "order_branch_no", "order_no")
    held = dict(zip(("last_observed_at", "last_observed_place"), order, strict=False))
    observed = {name: source for name, source in held.items() if name in target.columns and source in incoming.columns}
    return upsert(target, incoming, keys, list(order), now, "last_seen_at", "first_seen_at", observed)


def upsert_calendar(target: DataFrame, incoming: DataFrame, now: Column, order: list[str]) -> DataFrame:
    return upsert(target, incoming, ("market", "trade_date"), order, now, "updated_at")


def upsert_master(target: DataFrame, incoming: DataFrame, now: Column, order: list[str]) -> DataFrame:
    """Instrument master after one or more listing files; of equal symbols the one last in `order` stays."""
    return upsert(target, incoming, ("symbol", "market"), order, now, "updated_at")
