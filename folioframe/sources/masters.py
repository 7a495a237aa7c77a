"""Instrument master files: staged NDJSON and fixed-width CP949 listings."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.functions.text import blank_to_null
from folioframe.session import KOREAN_CONF

MASTER_COLUMNS = (
    "symbol", "market", "standard_code", "name", "group_code", "etp_code", "idx_large_code", "idx_mid_code",
    "idx_small_code",
)
DEFAULT_MARKET = "KRX"

STAGED_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in (*MASTER_COLUMNS, "raw_data")])


def read_staged_master(spark: SparkSession, path: str) -> DataFrame:
    """Scan of staged NDJSON with the master's cleaning: blanks to NULL, market defaulted, blank symbols dropped."""
    return clean_master(spark.read.schema(STAGED_SCHEMA).json(path))


def clean_master(staged: DataFrame) -> DataFrame:
    """The cleaning alone. Columns beyond the master's (a sequence, say) are carried."""
    codes = {name: blank_to_null(F.col(name)) for name in MASTER_COLUMNS[4:]}
    return staged.withColumns({
        "market": F.coalesce(blank_to_null(F.col("market")), F.lit(DEFAULT_MARKET)),
        **codes,
    }).filter(blank_to_null(F.col("symbol")).isNotNull())


class Layout(NamedTuple):
    """Where the master's codes lie at the end of each line: column, first byte, bytes, counted within the last
    `tail` bytes."""

    tail: int
    fields: tuple[tuple[str, int, int], ...]


# Bytes of the codes in the three listing files.
LAYOUTS = {
    "KOSPI": Layout(228, (
        ("group_code", 0, 2),
        ("idx_large_code", 3, 4),
        ("idx_mid_code", 7, 4),
        ("idx_small_code", 11, 4),
        ("etp_code", 22, 1),
    )),
    "KOSDAQ": Layout(222, (
        ("group_code", 0, 2),
        ("idx_large_code", 3, 4),
        ("idx_mid_code", 7, 4),
        ("idx_small_code", 11, 4),
        ("etp_code", 18, 1),
    )),
    "KONEX": Layout(184, (
        ("group_code", 0, 2),
    )),
}

_SYMBOL_BYTES, _STANDARD_BYTES = 9, 12


def allow_korean(spark: SparkSession) -> None:
    """Let the session decode the Korean charset, leniently. Sessions of `build_session` do so from the start; in
    another one the settings are made once and stay, so that no plan built meanwhile sees them change back."""
    for key in KOREAN_CONF:
        if spark.conf.get(key) != "true":
            spark.conf.set(key, "true")


def _cp949(blob: Column) -> Column:
    """Text of CP949 bytes; bytes that do not decode are dropped."""
    return F.trim(F.replace(F.decode(blob, "x-windows-949"), F.lit("�"), F.lit("")))


def parse_fixed_width(lines: DataFrame, layout: Layout, line: str = "value",
                      market: str = DEFAULT_MARKET) -> DataFrame:
    """Master rows of fixed-width lines, cut by byte offset from raw bytes.

    A line is a 9-byte symbol, a 12-byte standard code, a name of any length and the layout's tail, counted
    from the line end. `raw_data` holds the columns and the whole tail as JSON.
    """
    allow_korean(lines.sparkSession)
    blob = F.col("_blob")
    carried = [name for name in lines.columns if name != line]
    head_end = F.octet_length(blob) - F.lit(layout.tail)
    name_from = _SYMBOL_BYTES + _STANDARD_BYTES

    def piece(start: Column, length: Column) -> Column:
        return _cp949(F.substring(blob, start, F.greatest(length, F.lit(0))))

    columns = {
        "symbol": piece(F.lit(1), F.least(F.lit(_SYMBOL_BYTES), head_end)),
        "market": F.lit(market),
        "standard_code": piece(
            F.lit(_SYMBOL_BYTES + 1), F.least(F.lit(_STANDARD_BYTES), head_end - F.lit(_SYMBOL_BYTES))),
        "name": piece(F.lit(name_from + 1), head_end - F.lit(name_from)),
    }
    tail_from = F.greatest(head_end, F.lit(0))
    for field, first, width in layout.fields:
        columns[field] = piece(tail_from + F.lit(first + 1), F.lit(width))
    for field in MASTER_COLUMNS:
        columns.setdefault(field, F.lit(None).cast("string"))
    columns["tail"] = piece(tail_from + F.lit(1), F.lit(layout.tail))

    # No string function may touch the line before the cut: its bytes are not UTF-8.
    rows = lines.withColumn("_blob", F.col(line).cast("binary")).select(*carried, *[col.alias(name) for name, col in columns.items()])
    return rows.filter(F.col("symbol") != "").select(
        *carried, *MASTER_COLUMNS, F.to_json(F.struct(*columns)).alias("raw_data")
    )


def read_fixed_width_master(spark: SparkSession, path: str, listing: str) -> DataFrame:
    """One listing file (`KOSPI`, `KOSDAQ` or `KONEX`) to cleaned master rows."""
    return clean_master(parse_fixed_width(spark.read.text(path), LAYOUTS[listing]))
