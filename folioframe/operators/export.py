"""Parquet export of stored tables with a manifest: of row counts, or of what each part holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folioframe.operators.tables import part_name
from folioframe.schemas import TABLES
from folioframe.session import delete_path, is_written

PARTS = "table STRING, part STRING, rows LONG, digest STRING"


def export(spark: SparkSession, tables: dict[str, DataFrame], out: str) -> DataFrame:
    """Write each table to `out/<name>` and a manifest to `out/manifest`; returns the manifest.

    Fails if any of the paths exists. Rows are counted by the write itself.
    """
    rows = []
    for name, df in tables.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(f"{out}/{name}")
        rows.append((name, seen.get["rows"], name))
    manifest = spark.createDataFrame(rows, "table STRING, rows LONG, path STRING").withColumns({
        "format": F.lit("parquet"), "created_at": F.localtimestamp(),
    })
    manifest.coalesce(1).write.mode("errorifexists").json(f"{out}/manifest")
    return spark.read.schema(manifest.schema).json(f"{out}/manifest")


def exported(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{out}/{name}")


def digests(rows: DataFrame, part: str) -> DataFrame:
    """part, rows and `digest` of what each part holds: equal for equal rows in whatever order, files and columns.

    Two hashes of every row, added up in two ways that combine within tasks; a row more, less, changed or repeated
    gives another digest.
    """
    columns = [F.col(name) for name in sorted(rows.columns) if name != part]
    marked = rows.select(F.col(part).alias("part"), F.xxhash64(*columns).alias("_a"), F.xxhash64(F.lit(1), *columns).alias("_b"))
    found = marked.groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor("_a").alias("_a"), F.sum(F.col("_b").cast("decimal(38,0)")).alias("_b"))
    return found.select("part", "rows", F.concat_ws("-", F.col("rows").cast("string"), F.hex("_a"), F.col("_b").cast("string")).alias("digest"))


def _stored(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table with its part, stored or exported."""
    part = part_name(name)
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in TABLES[name].fields)
    return spark.read.schema(f"{columns}, {part} string").parquet(f"{root}/{name}")


def _manifest(spark: SparkSession, out: str) -> DataFrame:
    if is_written(spark, f"{out}/manifest"):
        return spark.read.schema(PARTS).json(f"{out}/manifest")
    return spark.createDataFrame([], PARTS)


def export_changed(spark: SparkSession, root: str, names: list[str], out: str) -> DataFrame:
    """Bring the export at `out` up to date with the stored tables; returns table, part, rows and status of each part:
    `exported`, `unchanged` or `removed`.

    The parts' digests, a handful a table, are compared with those of the last export's manifest; only parts that differ
    are written, and parts that are gone are deleted. The manifest is written last: after a failure the next run
    compares with the old one and does the rest again.
    """
    before = {(row["table"], row["part"]): row["digest"] for row in _manifest(spark, out).collect()}
    kept, told = [], []
    for name in names:
        rows, part = _stored(spark, root, name), part_name(name)
        now = digests(rows, part).collect()
        changed = [row["part"] for row in now if before.get((name, row["part"])) != row["digest"]]
        if changed:
            # NULL is a part of its own, of rows without a time.
            chosen = F.col(part).isin([value for value in changed if value is not None]) | (
                F.col(part).isNull() if None in changed else F.lit(False))
            rows.filter(chosen).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(
                f"{out}/{name}")
        kept += [(name, row["part"], row["rows"], row["digest"]) for row in now]
        told += [(name, row["part"], row["rows"], "exported" if row["part"] in changed else "unchanged") for row in now]
        gone = {value for table, value in before if table == name} - {row["part"] for row in now}
        for value in sorted(gone, key=str):
            delete_path(spark, f"{out}/{name}/{part}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}")
            told.append((name, value, 0, "removed"))
    spark.createDataFrame(kept, PARTS).coalesce(1).write.mode("overwrite").json(f"{out}/manifest")
    return spark.createDataFrame(told, "table STRING, part STRING, rows LONG, status STRING")


def broken_parts(spark: SparkSession, out: str, names: list[str]) -> DataFrame:
    """table and part of the export at `out` that do not hold what its manifest says; none if all is well."""
    found = None
    for name in names:
        there = digests(_stored(spark, out, name), part_name(name)).select(F.lit(name).alias("table"), "part", "digest")
        found = there if found is None else found.unionByName(there)
    told = _manifest(spark, out).filter(F.col("table").isin(names)).select("table", "part", F.col("digest").alias("_told"))
    same = F.col("a.table").eqNullSafe(F.col("b.table")) & F.col("a.part").eqNullSafe(F.col("b.part"))
    both = found.alias("a").join(told.alias("b"), same, "full_outer")
    return both.filter(~F.col("a.digest").eqNullSafe(F.col("b._told"))).select(
        F.coalesce("a.table", "b.table").alias("table"), F.coalesce("a.part", "b.part").alias("part"))


def reload_checked(spark: SparkSession, out: str, name: str) -> DataFrame:
    """An exported table, if every part of it holds what the manifest says."""
    broken = [str(row["part"]) for row in broken_parts(spark, out, [name]).collect()]
    if broken:
        raise ValueError(f"parts of {name} that do not match their digests: {', '.join(sorted(broken))}")
    return _stored(spark, out, name).drop(part_name(name))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table, in one job."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables.items()
    ]
    result = counted[0]
    for one in counted[1:]:
        result = result.unionByName(one)
    return result


def outcome_counts(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals of a batch: all, ok, error, and saved or not among the ok ones."""
    status, history = F.col("status"), F.col("history_status")
    return outcomes.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(status == "ok").alias("success_count"),
        F.count_if(status == "error").alias("error_count"),
        F.count_if(history == "saved").alias("saved_count"),
        F.count_if(history == "not_saved").alias("not_saved_count"),
    )
