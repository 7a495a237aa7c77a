"""Registration of queries, and the rendering of dates and times at their edge."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.registry.standins import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
UNITS: dict[str, str] = {}


def rendered(df: DataFrame) -> DataFrame:
    """Dates and times as text, so that both engines hand over equal values."""
    def one(name: str, kind: str):
        if kind == "date":
            return F.date_format(name, "yyyy-MM-dd").alias(name)
        if kind in ("timestamp", "timestamp_ntz"):
            return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)
        return F.col(name)

    return df.select(*[one(field.name, field.dataType.typeName()) for field in df.schema.fields])


def query(name: str, units: str, sql: str | None = None, *, dates: str = "", times: str = ""):
    """Register a query for the inventory units named, with its SQL. `dates` and `times` are the SQL's columns
    of those types, rendered like Spark's."""
    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: rendered(build(Tables(spark, folder)))
        UNITS[name] = units
        if sql is not None:
            casts = [f"CAST({day} AS VARCHAR) AS {day}" for day in dates.split()]
            casts += [f"strftime({time}, '%Y-%m-%d %H:%M:%S.%f') AS {time}" for time in times.split()]
            replace = f" REPLACE ({', '.join(casts)})" if casts else ""
            ORACLES[name] = f"SELECT *{replace} FROM (\n{sql.strip()}\n) AS answer"
        return build

    return register


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(part.strip() for part in parts) + "\n"
