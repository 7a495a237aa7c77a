"""Streaming jobs run to the end of what has arrived, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.operators import merge, tables
from folioframe.plans import portfolio
from folioframe.registry.core import ctes, query
from folioframe.registry.merges import now
from folioframe.registry.standins import DAILY, SNAPS, SNAPSHOT_COLUMNS, account_sql, cents_sql
from folioframe.session import scratch_path
from folioframe.streaming import jobs


ARRIVALS = 3


def arriving(t):
    """The events as a stream of three arrivals, the latest events in the first, read an arrival a batch.

    A job whose answer hung on the order or size of its batches would differ from its SQL. Every arrival has as many files
    as the table has tasks, so a larger table makes larger batches and not more of them: a merge rewrites the parts that a
    batch meets, and a batch a file would rewrite the same month once for every task."""
    events, folder = t.read("events"), scratch_path(t.spark, "arriving")
    at = F.col("ts").cast("timestamp").cast("double")
    first, last = events.agg(F.min(at), F.max(at)).first()
    place = F.floor((F.lit(last) - at) / (F.lit(last - first) / ARRIVALS + 1))
    files = events.rdd.getNumPartitions()
    for part in range(ARRIVALS):
        events.filter(F.coalesce(place, F.lit(ARRIVALS - 1)) == part).repartition(files).write.mode("append").parquet(folder)
    return jobs.read_files(t.spark, folder, events.schema, files_per_batch=files)


def _snapshots(t):
    return arriving(t).selectExpr(*[f"{expr} AS {name}" for name, expr in SNAPSHOT_COLUMNS.items()])


def wait(stream_query):
    stream_query.awaitTermination()
    if stream_query.exception() is not None:
        raise stream_query.exception()


@query("stream_snapshot_ingest", "K1 B7", ctes(SNAPS) + """
SELECT *, CAST(snapshot_at AS DATE) AS snap_date FROM snaps""", dates="snap_date", times="snapshot_at")
def _(t):
    out, state = scratch_path(t.spark, "ingest"), scratch_path(t.spark, "ingest-state")
    stream = _snapshots(t)
    wait(jobs.ingest_snapshots(stream, out, state))
    # A resumed run finds nothing new.
    wait(jobs.ingest_snapshots(stream, out, state))
    return t.spark.read.parquet(out)


@query("stream_order_upsert", "K2 B4", f"""
SELECT {account_sql('user_id')} AS account_id, CAST(ts AS DATE) AS order_date, event_type AS order_no,
       arg_max({cents_sql('value')}, (ts, event_id)) AS filled_amount FROM events
GROUP BY user_id, CAST(ts AS DATE), event_type""", dates="order_date")
def _(t):
    root, state = scratch_path(t.spark, "tables"), scratch_path(t.spark, "upsert-state")
    wait(_upserted(t, sightings(arriving(t)), root, state))
    return _kept_orders(t, root)


def sightings(events):
    return events.select(
        F.expr(account_sql("user_id")).alias("account_id"), F.lit("01").alias("account_product_code"),
        F.lit("brokerage").alias("account_type"), F.col("ts").cast("date").alias("order_date"), F.lit("").alias("order_branch_no"),
        F.col("event_type").alias("order_no"), F.expr(cents_sql("value")).alias("filled_amount"), F.col("ts").alias("seen_at"),
        F.col("event_id").alias("place"),
    )


def _upserted(t, seen, root, state):
    tables.create(t.spark, root, "domestic_orders")
    return jobs.upsert_stream(seen, root, "domestic_orders",
                              lambda target, batch: merge.upsert_orders(target, batch, now()), state)


def _kept_orders(t, root):
    return tables.read_table(t.spark, root, "domestic_orders").select("account_id", "order_date", "order_no", "filled_amount")


@query("stream_order_upsert_two_tables", "K2 B4", f"""
SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS desk, {account_sql('user_id')} AS account_id,
       CAST(ts AS DATE) AS order_date, event_type AS order_no,
       arg_max({cents_sql('value')}, (ts, event_id)) AS filled_amount FROM events
GROUP BY user_id, CAST(ts AS DATE), event_type""", dates="order_date")
def _(t):
    """Two tables of one name in two folders, each kept by its own stream, both at once; their checkpoints end alike."""
    events, running, out = arriving(t), [], None
    for rest, desk in enumerate(("even", "odd")):
        folder = scratch_path(t.spark, f"desk-{desk}")
        seen = sightings(events.filter(F.col("user_id") % 2 == rest))
        running.append((desk, f"{folder}/tables", _upserted(t, seen, f"{folder}/tables", f"{folder}/state")))
    for desk, root, stream in running:
        wait(stream)
        kept = _kept_orders(t, root).withColumn("desk", F.lit(desk))
        out = kept if out is None else out.unionByName(kept)
    return out


def _windowed(t, every, compact=False):
    out, state = scratch_path(t.spark, "windows"), scratch_path(t.spark, "windows-state")

    def last(rows):
        return jobs.last_per_window(rows, ["account_id", "account_type"], "total_eval_amt", every=every, tie="id")

    wait(jobs.write_partials(_snapshots(t), last, out, state))
    if compact:
        jobs.compact_partials(t.spark, out, last)
    return jobs.read_partials(t.spark, out, last).drop("id")


def _window_sql(grain):
    return ctes(SNAPS) + f"""
SELECT account_id, account_type, date_trunc('{grain}', snapshot_at)::TIMESTAMP AS window_start, max(snapshot_at) AS snapshot_at,
       arg_max(total_eval_amt, (snapshot_at, id)) AS total_eval_amt
FROM snaps WHERE total_eval_amt IS NOT NULL GROUP BY account_id, account_type, date_trunc('{grain}', snapshot_at)"""


@query("stream_daily_last_value", "K3 E1", _window_sql("day"), times="window_start snapshot_at")
def _(t):
    return _windowed(t, "1 day", compact=True)


@query("stream_minute_last_value", "K3 M", _window_sql("minute"), times="window_start snapshot_at")
def _(t):
    return _windowed(t, "1 minute")


@query("portfolio_daily_change_kept_days", "G3 K3", ctes(SNAPS, DAILY) + """,
totals AS (SELECT snap_date, CAST(sum(total_eval_amt) AS BIGINT) AS total_eval_amt, count(DISTINCT account_id) AS account_count
           FROM daily GROUP BY snap_date),
moved AS (SELECT *, lag(total_eval_amt) OVER (ORDER BY snap_date) AS before FROM totals)
SELECT 'ALL' AS account_id, snap_date, total_eval_amt, before AS prev_total_eval_amt, total_eval_amt - before AS change_amt,
       round((total_eval_amt - before) / nullif(CAST(before AS DOUBLE), 0) * 100, 2) AS change_pct, account_count
FROM moved ORDER BY snap_date DESC LIMIT 14""", dates="snap_date")
def _(t):
    """The change of days from a daily table that the stream keeps, so that no raw snapshot is curated again."""
    days = _windowed(t, "1 day", compact=True).withColumn("snap_date", F.col("window_start").cast("date"))
    return portfolio.daily_change(days)


@query("stream_duplicate_drop", "K4", """
SELECT user_id, event_type, CAST(ts AS DATE) AS day, arg_min(event_id, (ts, event_id)) AS event_id FROM events
GROUP BY user_id, event_type, CAST(ts AS DATE)""", dates="day")
def _(t):
    stream = arriving(t).select("user_id", "event_type", F.col("ts").cast("date").alias("day"), "ts", "event_id")
    out, state = scratch_path(t.spark, "distinct"), scratch_path(t.spark, "distinct-state")

    def first(rows):
        return jobs.first_per_key(rows, ["user_id", "event_type", "day"], ["ts", "event_id"])

    wait(jobs.write_partials(stream, first, out, state))
    return jobs.read_partials(t.spark, out, first).select("user_id", "event_type", "day", "event_id")
