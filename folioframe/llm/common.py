"""Reading, per-batch mapping and splitting rules shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.session import drop_scratch, materialize, scratch_path

Arrays = dict[str, list]
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back, so that later steps survive lost executors."""
    path = scratch_path(df.sparkSession, name)
    out = materialize(df, path)
    _PATHS[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for frame in frames:
        drop_scratch(frame.sparkSession, _PATHS.pop(frame))


def unused(columns: Iterable[str], name: str) -> str:
    """`name`, with underscores added until no column is called so (whatever its case)."""
    taken = {column.lower() for column in columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(df: DataFrame) -> Column:
    """Two hashes of all columns: rows with equal ones are the same row, repeated."""
    parts = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if f.dataType.simpleString().find("map<") >= 0 else F.col(f"`{f.name}`")
             for f in df.schema.fields]
    return F.struct(F.xxhash64(*parts).alias("x"), F.xxhash64(F.lit(1), *parts).alias("y"))


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; NULL for a NULL id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string")) % modulus


def unit_hash(*columns: str, seed: str) -> Column:
    """A value in [0, 1) fixed by the columns, for sampling by rate; other seeds give independent values."""
    return (F.xxhash64(*[F.col(c) for c in columns], F.lit(seed)) % (1 << 30) + (1 << 30)) % (1 << 30) / float(1 << 30)


def map_texts(
    df: DataFrame,
    keep: list[str],
    work: Callable[[list[str]], Arrays],
    fields: list[T.StructField],
    text: str = "text",
) -> DataFrame:
    """`keep` columns of `df` beside the columns that `work` makes of each batch's texts (NULL as empty).

    Map-side only, one Arrow batch at a time; Spark bounds a batch by bytes. `work` returns a list per field. A
    column of `keep` named like a field is replaced. The frame is narrowed to what is used before rows leave the JVM.
    """
    names = [field.name for field in fields]
    kept = [column for column in keep if column not in names]
    shared = text in kept and df.schema[text].dataType == T.StringType()
    source = df.select(*[F.col(f"`{c}`") for c in kept],
                       *([] if shared else [F.col(text).cast("string").alias("__text")]))
    schema = T.StructType(source.schema.fields[:len(kept)] + fields)
    at = kept.index(text) if shared else len(kept)
    arrow = {field.name: _arrow_type(field.dataType) for field in fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [value or "" for value in batch.column(at).to_pylist()]
            made = work(texts)
            columns = list(batch.columns[:len(kept)]) + [pa.array(made[name], arrow[name]) for name in names]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    return source.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def join_spans(spans: Column) -> Column:
    """`kind:start:end`, comma-joined, of an array of structs with those fields."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def count_kind(spans: str, kind: str) -> Column:
    """How many structs of the array column have that `kind`."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
