import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import topk

SCHEMA = "vec_id bigint, embedding array<double>"


def plain(rows, k=5, every=50):
    usable = [(i, [math.floor(256 * v) for v in x], x) for i, x in rows
              if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    asking = {}
    for i, q, x in usable:
        if i % every == 0 and (i not in asking or x < asking[i][1]):
            asking[i] = (q, x)
    out = []
    for i, (q, _) in asking.items():
        scored = []
        for j, x, _ in usable:
            if j != i and len(x) == len(q):
                s = sum(a * b for a, b in zip(q, x, strict=True))
                scored.append((j, max(-(2 ** 63 - 1), min(2 ** 63 - 1, s))))
        out += [(i, r, j, s) for r, (j, s) in enumerate(sorted(scored, key=lambda p: (-p[1], p[0]))[:k], 1)]
    return sorted(out)


def got(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, topk.search(frame, **options).collect()))


@pytest.mark.parametrize("ring,pivots", [(4096, 64), (40, 8), (7, 3)])
def test_against_all_pairs(spark, ring, pivots):
    rng = np.random.default_rng(ring)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.4 * (i % 3), 12)).tolist()) for i in range(700)]
    assert got(spark, rows, every=10, ring=ring, pivots=pivots) == plain(rows, every=10)


def test_test_embeddings_against_all_pairs(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    assert sorted(map(tuple, topk.search(table, ring=64).collect())) == plain(rows)


def test_pruned_rings_are_not_read(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (np.eye(8)[i % 4] * 40 + rng.normal(0, 0.05, 8)).tolist()) for i in range(400)]
    assert got(spark, rows, every=20, ring=25, pivots=8) == plain(rows, every=20)


def test_ties_copies_nulls_and_odd_vectors(spark):
    same = [1.0, 0.5]
    rows = [(i, same) for i in range(0, 130)] + [(50, same), (60, [0.1, None]), (61, None), (None, same), (62, [float("nan"), 1.0]),
            (63, [float("inf"), 1.0]), (100, [1.0, 0.5, 2.0]), (101, [3.0, 0.5, 2.0]), (150, []), (151, [])]
    rows = [r for r in rows if r[0] not in (60, 61, 62, 63) or r[1] is not same]
    random.Random(2).shuffle(rows)
    assert got(spark, rows, ring=16, pivots=4) == plain(rows)


@pytest.mark.parametrize("ring", [4096, 16])
def test_repeated_rows_count_and_the_smallest_vector_of_an_id_asks(spark, ring):
    rng = random.Random(ring)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(120)]
    rows += [rows[7]] * 3 + [(8, [9.0, 9.0, 9.0, 9.0])] * 2 + [(9, [-9.0, -9.0, -9.0, -9.0])] * 3 + [rows[50]] * 2 + [(100, [-5.0, 1.0, 2.0, 3.0]), (100, [5.0, 1.0, 2.0, 3.0])]
    rng.shuffle(rows)
    found = got(spark, rows, ring=ring, pivots=4)
    assert found == plain(rows) and {2, 3} & {sum(r[0] == 0 and r[2] == j for r in found) for j in (8, 9)}


def test_sql_gives_the_same_on_repeated_rows(spark, tmp_path):
    import duckdb

    from folioframe.llm.queries import ORACLES

    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(110)]
    rows += [rows[7]] * 4 + [rows[50]] + [(100, [3.0, -2.0, 1.0])]
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.write.parquet(str(tmp_path / "embeddings"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings/*.parquet'")
    assert sorted(map(tuple, con.execute(ORACLES["op9_pivot_topk"]).fetchall())) == got(spark, rows)


def test_few_rows_large_values_and_empty(spark):
    rows = [(0, [1e9, -2e9]), (1, [3e9, 1.0]), (2, [-1.0, -1.0])]
    assert got(spark, rows) == plain(rows)
    assert got(spark, [(0, [1.0])]) == [] and got(spark, [(1, [1.0]), (2, [2.0])]) == []
    assert topk.search(spark.createDataFrame([(0, [1.0])], SCHEMA).filter(F.lit(False))).collect() == []


def test_clashing_columns(spark):
    frame = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], SCHEMA)
    extra = frame.select("*", *[F.lit("x").alias(c) for c in ("x", "pivot", "distance", "block", "ids", "score", "rank")])
    assert sorted(map(tuple, topk.search(extra).collect())) == plain([(i, [float(i), 1.0]) for i in range(60)])


def test_farthest_first_takes_distinct_points():
    points = np.array([[0.0, 0], [0, 0], [5, 0], [0, 9]])
    assert len(topk.farthest_first(points, 10)) == 3
