"""Incremental ingest, upsert, last value per window and duplicate removal.

Every job checkpoints to a folder the caller names and can be stopped and resumed. No result hangs on how the input is
cut into batches or on the order in which batches come, and no row is too late: a batch leaves its own partial answer,
under its number, and reading folds the partial answers by the time that the rows carry.
"""

from __future__ import annotations

import re
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from folioframe.operators.merge import one_per_key
from folioframe.operators.tables import rewrite
from folioframe.session import delete_if_bare, delete_path

ORDER_KEYS = ["account_id", "account_product_code", "order_date", "order_branch_no", "order_no"]
BATCH = "batch"


def read_files(spark: SparkSession, folder: str, schema: StructType, names: str = "*.parquet",
               files_per_batch: int = 1000) -> DataFrame:
    """Parquet files as they arrive in a folder, those whose name matches `names`. The number of files only says
    how much a batch reads."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", names)
        .option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def ingest_snapshots(stream: DataFrame, out: str, checkpoint: str, time: str = "snapshot_at") -> StreamingQuery:
    """Append snapshots to a table split by day, each file exactly once."""
    return (
        stream.withColumn("snap_date", F.col(time).cast("date"))
        .writeStream.format("parquet").outputMode("append").partitionBy("snap_date")
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def upsert_stream(stream: DataFrame, root: str, table: str, merge: Callable[[DataFrame, DataFrame], DataFrame],
                  checkpoint: str) -> StreamingQuery:
    """Merge each micro-batch into a stored table.

    The merge decides by what the rows say, such as the time of observation that `merge.upsert_orders` stores, so
    batches may come in any order and a batch run again after a failure leaves the same rows. What a failed batch has
    staged is told by the table's folder, the whole path of the checkpoint and the batch's number.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rewrite(batch.sparkSession, root, table, batch, merge, batch=f"{checkpoint.rstrip('/')}#{batch_id}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def last_per_window(rows: DataFrame, keys: list[str], value: str, time: str = "snapshot_at", every: str = "1 day",
                    start: str | None = None, tie: str | None = None) -> DataFrame:
    """Latest non-NULL value of each key and window among the rows of a batch, or among such partial answers.

    `time` is zone-less and so are the windows; `start` shifts them (`15 hours` makes days of Seoul). Of one time the
    row with the highest `tie` counts, or without one the highest value.
    """
    begun = F.window(F.col(time), every, startTime=start)["start"].alias("window_start")
    kept = [*keys, "window_start", time, value, *([tie] if tie else [])]
    seen = rows.filter(F.col(value).isNotNull())
    if "window_start" not in rows.columns:
        seen = seen.withColumn("window_start", begun)
    return one_per_key(seen.select(*kept), (*keys, "window_start"), [time, tie or value])


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The earliest row of each key, by `order`, among the rows of a batch or among such partial answers."""
    return one_per_key(rows, tuple(keys), order, keep="first")


def write_partials(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], out: str,
                   checkpoint: str) -> StreamingQuery:
    """Write `partial(batch)` of each micro-batch under its number; a batch run again replaces its own rows.

    No state is kept between batches."""
    def write(batch: DataFrame, batch_id: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{out}/{BATCH}={batch_id}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_partials(spark: SparkSession, out: str, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The answer over all batches so far: `fold` is the function that made the partial answers."""
    return fold(spark.read.parquet(out).drop(BATCH))


def compact_partials(spark: SparkSession, out: str, fold: Callable[[DataFrame], DataFrame]) -> None:
    """Fold the partial answers of all batches so far into one.

    The folded answer is written before the old ones go, and what goes is the very files that were folded: a batch
    that is run again meanwhile leaves new files, which stay. Folding a row twice changes nothing, so a failure in
    between does no harm, nor does a batch that is run again later. A batch that replaces files while they are folded
    makes the compaction fail; it has deleted nothing then and may be run again.
    """
    files = spark.read.parquet(out).inputFiles()
    old = {int(re.search(rf"/{BATCH}=(-?[0-9]+)/", file)[1]) for file in files}
    if len(old) > 1:
        rows = spark.read.option("basePath", out).parquet(*files).drop(BATCH)
        fold(rows).write.mode("errorifexists").parquet(f"{out}/{BATCH}={min(0, *old) - 1}")
        for file in files:
            delete_path(spark, file)
        for batch in old:
            delete_if_bare(spark, f"{out}/{BATCH}={batch}")
