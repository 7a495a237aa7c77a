"""Connected components of an undirected graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import discard, stored


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """node and root (the smallest node reachable) for every node of the edges (a, b).

    Alternates two steps that keep connectivity: every node's larger neighbours are linked to its smallest one, then
    every node's smaller neighbours and itself are. Each round is stored, and the edges never outnumber the first
    ones twice. A hub's edges meet only the one row that holds its smallest neighbour, in a join that Spark may split.
    """
    current = stored(edges.filter("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    before = None
    for _ in range(limit):
        mark = current.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark == before or not mark["n"]:
            break
        before = mark
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        larger = both.join(least, "a").filter("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        wide = larger.distinct()
        smallest = wide.groupBy("a").agg(F.min("b").alias("m"))
        linked = wide.join(smallest, "a").select(F.explode(F.array(
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        before_it, current = current, stored(linked.filter("a != b").distinct(), "components")
        discard(before_it)
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
