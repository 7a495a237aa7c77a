import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import whitening
from tests.llm.helpers import SF

SCHEMA = "vec_id bigint, embedding array<double>"


def plain(rows):
    """(vec_id, deviation) of each usable row, their x, the mean and the covariance's eigenvalues and vectors."""
    used = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({x for _, x in used}), dtype=float)
    n, sums = len(fit), [sum(column) for column in zip(*{x for _, x in used}, strict=True)]
    centred = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    deviations = [(i, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))) for i, x in used]
    return deviations, used, fit.mean(axis=0), values[::-1], vectors[:, ::-1].T, n


def hold(found, rows, components=4):
    """Checks everything that does not hang on an eigenvector's sign."""
    deviations, used, mean, values, vectors, n = plain(rows)
    count = min(components, int((values > 1e-9 * values.sum()).sum()))
    assert len(found) == len(used) * count
    assert sorted((r["vec_id"], r["deviation"]) for r in found if r["component"] == 1) == sorted(deviations)
    by = {}
    for r in found:
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-10)
        by.setdefault(r["component"], {})[r["vec_id"]] = r["whitened"]
    for k, got in by.items():
        want = {i: (np.array(x) - mean) @ vectors[k - 1] / math.sqrt(values[k - 1]) for i, x in used}
        sign = max(want, key=lambda i: abs(want[i]))
        sign = math.copysign(1, want[sign] * got[sign])
        assert max(abs(got[i] * sign - want[i]) for i in want) < 1e-8
    return by


def got(spark, rows, **options):
    return whitening.whiten(spark.createDataFrame(rows, SCHEMA), **options).collect()


def test_given_vectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    hold(whitening.whiten(table).collect(), [(r["vec_id"], r["embedding"]) for r in table.collect()])


def test_copies_count_once_and_unusable_rows_go(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) * [9, 7, 5, 3, 1, 1]).tolist()) for i in range(80)]
    rows += [(1000 + i, rows[0][1]) for i in range(500)] + [(2000, None), (2001, [None] * 6), (2002, [math.nan] * 6),
            (2003, [math.inf] + [0.0] * 5), (2004, []), (2005, [-0.0, 0.0, 0.0, 0.0, 0.0, -0.001])]
    found = got(spark, rows)
    by = hold(found, rows)
    assert len({by[1][i] for i in [0, *range(1000, 1500)]}) == 1


def test_a_null_id_stays_and_other_lengths_go(spark):
    rows = [(None, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [0.0, 7.0]), (3, [1.0]), (4, [1.0, 2.0, 3.0])]
    found = got(spark, rows)
    assert {r["vec_id"] for r in found} == {None, 1, 2} and {r["component"] for r in found} == {1, 2}


def test_few_dimensions_low_rank_and_nothing_to_fit(spark):
    rng = np.random.default_rng(5)
    flat = [(i, (rng.normal(size=2) @ np.array([[1, 2, 3, 4, 5], [5, -1, 0, 1, 2]]) // 1 * 4).tolist()) for i in range(60)]
    hold(got(spark, [(i, [float(i), float(i * i % 7)]) for i in range(50)]), [(i, [float(i), float(i * i % 7)]) for i in range(50)])
    assert {r["component"] for r in got(spark, flat)} <= {1, 2, 3, 4}
    assert got(spark, [(1, [1.0, 2.0])]) == [] and got(spark, [(i, [1.0, 2.0]) for i in range(5)]) == []
    empty = whitening.whiten(spark.createDataFrame([(1, [1.0])], SCHEMA).filter(F.lit(False)))
    assert empty.collect() == [] and empty.columns[0] == "vec_id"
    with pytest.raises(ValueError):
        got(spark, flat, wanted=0)


def test_huge_entries_do_not_overflow(spark):
    rows = [(0, [1e30, 1.0]), (1, [-1e30, 2.0]), (2, [1e15, 3.0]), (3, [0.0, 4.0])]
    found = got(spark, rows)
    assert {r["vec_id"] for r in found} == {0, 1, 2, 3} and max(r["deviation"] for r in found) == (1 << 63) - 1


def test_clashing_columns(spark):
    frame = spark.createDataFrame([(i, [float(i), float(i % 3)]) for i in range(30)], SCHEMA)
    extra = frame.select("*", *[F.lit("x").alias(c) for c in ("x", "n", "component", "whitened", "at", "part")])
    assert sorted(map(tuple, whitening.whiten(extra).collect())) == sorted(map(tuple, whitening.whiten(frame).collect()))


def of(x):
    x = x - x.mean(axis=0)
    passes = []

    def multiply(w, ws):
        u = x @ w
        passes.append(1)
        return u @ x, u @ (x @ ws), float(u @ u)

    values, vectors = whitening.largest(multiply, x.shape[1], min(4, x.shape[1]), float(np.linalg.norm(x)))
    return x, values, vectors, len(passes)


@pytest.mark.parametrize("name", ["clusters", "noise", "equal", "pairs", "rank", "steep"])
def test_bidiagonalisation(name):
    rng = np.random.default_rng(6)
    x = {"clusters": (rng.normal(size=(10, 40)) * 20)[rng.integers(0, 10, 600)] + rng.normal(size=(600, 40)),
         "noise": rng.normal(size=(500, 30)), "equal": np.vstack([np.eye(9), -np.eye(9)]),
         "pairs": np.vstack([np.diag([5, 5, 5, 3, 3, 1, 1.0]), -np.diag([5, 5, 5, 3, 3, 1, 1.0])]),
         "rank": rng.normal(size=(90, 2)) @ rng.normal(size=(2, 12)),
         "steep": rng.normal(size=(300, 20)) * np.logspace(0, -6, 20)}[name]
    x, values, vectors, passes = of(x)
    want = np.linalg.svd(x, compute_uv=False)[:len(values)]
    assert len(values) == (2 if name == "rank" else 4) or values[2:].max() < 1e-9 * values[0]
    assert np.abs(values - want).max() < 1e-12 * want[0]
    assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() < 1e-12
    gram = x.T @ x
    assert max(np.linalg.norm(gram @ v - s * s * v) for s, v in zip(values, vectors, strict=True)) < 1e-10 * want[0] ** 2
    if name == "clusters":
        assert passes < 40
