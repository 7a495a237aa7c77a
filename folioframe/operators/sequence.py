"""The row before, in sequences of any length.

A window over a key sorts all its rows in one task. Here rows are range-dealt by key and order, which cuts long sequences
over tasks; each task looks back within its own rows, and of the task before a key's first row in a task needs only the
last one. One row a key and task travels for that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.session import materialize, scratch_path

_TASK = "_task"


def with_previous(rows: DataFrame, keys: list[str], order: list[str], values: list[str],
                  prefix: str = "previous_", tasks: int | None = None) -> DataFrame:
    """`rows` with `values` of the row before each, per key and in the order of `order`; NULL for a key's first row.

    `order` is to tell the rows of a key apart. NULLs come first in it, and count as a key of their own in `keys`. The
    dealt rows are written to the scratch folder: where a row lies must not change while its neighbour is looked up.
    """
    by = [*keys, *order]
    dealt = rows.repartitionByRange(tasks, *by) if tasks else rows.repartitionByRange(*by)
    placed = materialize(dealt.withColumn(_TASK, F.spark_partition_id()), scratch_path(rows.sparkSession, "dealt"))
    kept = F.struct(*values)
    rank = F.struct(*order)
    ends = placed.groupBy(*keys, _TASK).agg(F.max_by(kept, rank).alias("_end"), F.min(rank).alias("_first"))
    # A key's tasks, not its rows.
    earlier = Window.partitionBy(*keys).orderBy(_TASK)
    edges = ends.select(*keys, _TASK, "_first", F.lag("_end").over(earlier).alias("_edge")).filter(
        F.col("_edge").isNotNull()).select(
        *[F.col(name).alias(f"_of_{name}") for name in [*keys, _TASK]], F.col("_first"), "_edge")
    same = rank.eqNullSafe(F.col("_first"))
    for name in [*keys, _TASK]:
        same = same & F.col(name).eqNullSafe(F.col(f"_of_{name}"))
    within = Window.partitionBy(*keys, _TASK).orderBy(*order)
    looked = placed.withColumn("_within", F.lag(kept).over(within))
    found = looked.join(edges, same, "left").withColumn("_found", F.coalesce("_within", "_edge"))
    return found.select(*rows.columns, *[F.col("_found")[name].alias(f"{prefix}{name}") for name in values])
