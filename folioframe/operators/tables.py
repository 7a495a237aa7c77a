"""Stored tables: Parquet split by month, year or market, appended to or rewritten part by part."""

from __future__ import annotations

import datetime as dt
import hashlib
from typing import Callable, NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.operators.merge import split_bad
from folioframe.schemas import KEYS, SPLIT_COLUMN, TABLES, TIME_COLUMN
from folioframe.session import drop_scratch, is_written, scratch_path, shared_root

MONTH = "month"
PART = "part"
# Raw responses and random ids take about half the room that they take by Spark's default.
COMPRESSION = "zstd"


class Written(NamedTuple):
    """Rows that a rewrite took, and those it left out because a key column was NULL."""

    processed: int
    rejected: int


def month_of(time: str) -> Column:
    return F.date_format(time, "yyyy-MM").alias(MONTH)


def part_name(name: str) -> str:
    return MONTH if name in TIME_COLUMN else PART


def part_of(name: str) -> Column:
    """The part of the stored table that a row belongs to: its month, or the year or market of reference tables."""
    if name in TIME_COLUMN:
        return month_of(TIME_COLUMN[name])
    column = SPLIT_COLUMN[name]
    kind = TABLES[name][column].dataType.typeName()
    return (F.date_format(column, "yyyy") if kind == "date" else F.concat(F.lit("p-"), F.col(column))).alias(PART)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of `schema`, in its order and types: missing ones are added as NULL, others dropped."""
    return df.select(*[
        (F.col(field.name) if field.name in df.columns else F.lit(None)).cast(field.dataType).alias(field.name)
        for field in schema.fields
    ])


def read_table(spark: SparkSession, root: str, name: str, since: dt.date | None = None,
               until: dt.date | None = None) -> DataFrame:
    """A stored table with its full schema and its part; columns that older files lack read as NULL.

    `since` and `until` leave out the files of earlier and later months; the days themselves are up to the
    caller's own filter.
    """
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in TABLES[name].fields])
    rows = spark.read.schema(schema.add(part_name(name), T.StringType())).parquet(f"{root}/{name}")
    if name not in TIME_COLUMN:
        return rows.drop(PART)
    if since is not None:
        rows = rows.filter(F.col(MONTH) >= f"{since:%Y-%m}")
    if until is not None:
        rows = rows.filter(F.col(MONTH) <= f"{until:%Y-%m}")
    return rows


def _laid_out(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Rows with their part, gathered by it unless they are known to lie in a single one."""
    part = part_name(name)
    rows = conform(df, TABLES[name]).withColumn(part, part_of(name))
    # Without the hint each task would open a file in every part. AQE splits a part too large for one task.
    return rows if parts == 1 else rows.hint("rebalance", part)


def usable(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows that a keyed table can hold, and the rejects: those with a NULL in the key."""
    return split_bad(rows, *[key for key in KEYS.get(name, ()) if key in rows.columns])


def append(df: DataFrame, root: str, name: str, parts: int | None = None) -> int:
    """Append rows to a stored table and return how many; they are counted as they are written. Rows that the caller
    knows to lie in one part, as those stamped with one time do, are written where they are (`parts` 1).

    Rows with a NULL key are not for a keyed table: the merges leave them out, and here they raise.
    """
    seen, none = Observation(), F.lit(False)
    for key in KEYS.get(name, ()):
        none = none | F.col(key).isNull()
    checked = df.filter(F.when(none, F.raise_error(F.lit(f"NULL in the key of {name}"))).otherwise(F.lit(True))) \
        if name in KEYS else df
    counted = _laid_out(checked, name, parts).observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("append").partitionBy(part_name(name)).parquet(f"{root}/{name}", compression=COMPRESSION)
    return seen.get["rows"]


def parts_of(incoming: DataFrame, name: str) -> list[str]:
    """The parts of a stored table that `incoming` can meet: a handful of values, at most twelve months a year, or the
    markets or years at hand, so they are fetched."""
    return [row[0] for row in incoming.select(part_of(name)).distinct().collect() if row[0] is not None]


def touched(spark: SparkSession, root: str, name: str, parts: list[str]) -> DataFrame:
    """The rows of these parts of a stored table; a plain filter is sure to prune files."""
    part = part_name(name)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in TABLES[name].fields])
    stored = spark.read.schema(schema.add(part, T.StringType())).parquet(f"{root}/{name}")
    return stored.filter(F.col(part).isin(parts)).drop(part)


def insert(spark: SparkSession, root: str, name: str, incoming: DataFrame,
           absent: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """Append the rows that `absent(target, incoming)` finds missing, and return how many."""
    good, _ = usable(incoming, name)
    return append(absent(touched(spark, root, name, parts_of(good, name)), good), root, name)


NOTE = "root string, name string, batch string, processed bigint, rejected bigint"


def stage_path(spark: SparkSession, root: str, name: str, batch: str) -> str:
    """Where a named batch of one stored table is staged: no other table, wherever it lies, and no other batch has
    the same place."""
    told = "\n".join((root.rstrip("/"), name, batch))
    return f"{shared_root(spark)}/{name}-{hashlib.sha256(told.encode()).hexdigest()[:40]}"


def _noted(spark: SparkSession, note: str, root: str, name: str, batch: str) -> Written | None:
    """The counts of a stage that is complete; None if there is none. Another table's or batch's is refused."""
    if not is_written(spark, note):
        return None
    row = spark.read.schema(NOTE).parquet(note).first()
    if (row["root"], row["name"], row["batch"]) != (root.rstrip("/"), name, batch):
        raise ValueError(f"{note} was staged for batch {row['batch']} of {row['name']} in {row['root']}")
    return Written(row["processed"], row["rejected"])


def rewrite(spark: SparkSession, root: str, name: str, incoming: DataFrame,
            merge: Callable[[DataFrame, DataFrame], DataFrame], batch: str | None = None) -> Written:
    """Apply `merge(target, incoming)` to a stored table, touching only the parts that `incoming` has.

    The input is read once, into the shared folder; the merged parts follow it there, split as the table is, and
    replace the old ones in a last step. So the table is never read and overwritten by the same job, and parts that
    `incoming` lacks stay as they are. Under a `batch` name, which is unique for the table, the merged parts and the
    counts are found again: should the last step have failed half-way, a retry finishes it from them and returns the
    same counts. Rows with a NULL key are left out and counted.
    """
    where = stage_path(spark, root, name, batch) if batch else scratch_path(spark, name)
    given, merged, note = f"{where}-given", f"{where}-merged", f"{where}-note"
    counts = _noted(spark, note, root, name, batch) if batch else None
    if counts is None:
        seen = Observation()
        bad = F.lit(False)
        for key in KEYS.get(name, ()):
            bad = bad | (F.col(key).isNull() if key in incoming.columns else F.lit(True))
        marked = incoming.withColumn("_bad", bad)
        marked.observe(
            seen, F.count_if(~F.col("_bad")).alias("good"), F.count_if("_bad").alias("bad")
        ).write.mode("overwrite").parquet(given)
        counts = Written(seen.get["good"], seen.get["bad"])
        rows = spark.read.schema(marked.schema).parquet(given).filter("not _bad").drop("_bad")
        parts = parts_of(rows, name)
        _laid_out(merge(touched(spark, root, name, parts), rows), name, len(parts)).write.mode("overwrite").partitionBy(
            part_name(name)).parquet(merged)
        if batch:
            spark.createDataFrame([(root.rstrip("/"), name, batch, *counts)], NOTE).coalesce(1).write.mode(
                "overwrite").parquet(note)
    swap(spark, root, name, merged)
    # The note goes first: without it what is left of a stage counts as none.
    for path in ([note] if batch else []) + [given, merged]:
        drop_scratch(spark, path)
    return counts


def swap(spark: SparkSession, root: str, name: str, merged: str) -> None:
    """Put the parts at `merged` in place of the stored ones of the same names. They are laid out as the table is, so
    its files are copied without a shuffle."""
    part = part_name(name)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in TABLES[name].fields])
    rows = spark.read.schema(schema.add(part, T.StringType())).parquet(merged)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(f"{root}/{name}")


def create(spark: SparkSession, root: str, name: str) -> None:
    """An empty stored table."""
    _laid_out(spark.createDataFrame([], TABLES[name]), name).write.mode("errorifexists").partitionBy(
        part_name(name)).parquet(f"{root}/{name}")
