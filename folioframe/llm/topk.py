"""Exact top-k by inner product over a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it, and range-dealt by that key into rings: blocks of
neighbouring distances to one pivot. For q and x of any length, q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2, and the
triangle inequality bounds |q - x| from below by the gap between the query's distance to the pivot and the ring. A
query is answered in its own ring first; its k-th score there rules out every ring whose bound stays below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import stored, unit_hash

K = 5
EVERY = 50
PIVOTS = 64
SAMPLE = 4000
RING = 4096
# Doubles hold whole numbers up to here exactly.
EXACT = float(1 << 53)
SLACK = 1e-6
RINGS = """block bigint, dimension int, pivot int, low double, high double, norm double, kind string, ids binary,
           copies binary, vectors binary, q_ids binary, q_vectors binary, q_floor binary, q_count int, q_norm double, q_least double,
           reach array<struct<pivot: int, low: double, high: double>>"""
ANSWER = "query_id bigint, vec_id bigint, score bigint, copies bigint"


def packed(x: np.ndarray) -> tuple[str, np.ndarray]:
    """Whole numbers in the narrowest type that holds them."""
    most = np.abs(x).max(initial=0.0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return kind, x.astype(kind)


def quantise(rows: list) -> np.ndarray:
    return np.floor(256.0 * np.asarray(rows, np.float64))


def farthest_first(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to `count` pivots, each the sample point farthest from the ones before; fewer if points repeat."""
    if not len(sample):
        return sample
    chosen, apart = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < count and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0.0))


def choose_pivots(vectors: DataFrame, count: int, sample: int) -> dict[int, np.ndarray]:
    """Pivots by dimension, from about `sample` vectors at most, chosen by a hash of the id."""
    total = vectors.count()
    rows = vectors.filter(unit_hash("vec_id", seed="pivots") < sample / max(total, 1)).orderBy("vec_id").collect()
    by_size: dict[int, list] = {}
    for row in rows:
        by_size.setdefault(len(row["x"]), []).append(row["x"])
    return {size: farthest_first(quantise(group), count) for size, group in by_size.items()}


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond what doubles hold exactly, in Python's integers, held to 64 bits."""
    most = np.abs(queries).max(initial=0.0) * np.abs(vectors).max(initial=0.0) * max(vectors.shape[1], 1)
    if most < EXACT:
        return (queries @ vectors.T).astype(np.int64)
    whole = [[int(v) for v in row] for row in queries], [[int(v) for v in row] for row in vectors]
    limit = (1 << 63) - 1
    return np.array([[max(-limit, min(limit, sum(map(int.__mul__, q, x)))) for x in whole[1]] for q in whole[0]],
                    np.int64).reshape(len(queries), len(vectors))


def best(query_ids: np.ndarray, ids: np.ndarray, found: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, place in `ids`, score) of each query's k best, ties to smaller ids, rows of its own id left out."""
    out = []
    for query, row in zip(query_ids.tolist(), found, strict=True):
        allowed = np.flatnonzero(ids != query)
        if len(allowed) > k:
            floor = np.partition(row[allowed], len(allowed) - k)[len(allowed) - k]
            allowed = allowed[row[allowed] >= floor]
        order = allowed[np.lexsort((ids[allowed], -row[allowed]))][:k]
        out += [(query, int(j), int(row[j])) for j in order]
    return out


def build_rings(vectors: DataFrame, pivots: dict[int, np.ndarray], k: int, every: int, ring: int) -> DataFrame:
    """The index: one row a ring of at most `ring` vectors, with the queries among them, their floors (k-th score in
    the ring) and the range of their distances to each pivot of their dimension."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            sizes = np.array([len(r) for r in rows], np.int32)
            pivot, distance = np.zeros(len(rows), np.int32), np.zeros(len(rows))
            for size in np.unique(sizes):
                if size in pivots and size:
                    at = np.flatnonzero(sizes == size)
                    apart = distances(quantise([rows[i] for i in at]), pivots[size])
                    pivot[at], distance[at] = apart.argmin(axis=1), apart.min(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes), pa.array(pivot), pa.array(distance)],
                names=["vec_id", "copies", "x", "dimension", "pivot", "distance"])

    unique = vectors.groupBy("vec_id", "x").agg(F.count(F.lit(1)).alias("copies")).select("vec_id", "copies", "x")
    keyed = stored(unique.mapInArrow(
        assign, "vec_id bigint, copies bigint, x array<double>, dimension int, pivot int, distance double"), "topk-keyed")
    count = max(1, -(-keyed.count() // ring))
    # Of several vectors with one id the smallest asks; hardly any id has more than one.
    several = keyed.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("first")).filter("n > 1").select("vec_id", "first")
    asking = (F.col("vec_id") % every == 0) & F.coalesce(F.col("x") == F.col("first"), F.lit(True))
    dealt = keyed.join(several, "vec_id", "left").select(
        "vec_id", "x", "dimension", "pivot", "distance", "copies", asking.alias("asks")).repartitionByRange(count, "dimension", "pivot", "distance", "vec_id").sortWithinPartitions(
        "dimension", "pivot", "distance", "vec_id")

    def close(rows: list[tuple], block: int) -> tuple:
        ids = np.array([r[0] for r in rows], np.int64)
        dimension, pivot = rows[0][2], rows[0][3]
        x = quantise([r[1] for r in rows]).reshape(len(rows), dimension)
        apart = np.array([r[4] for r in rows])
        norms = np.sqrt((x * x).sum(axis=1))
        asks = np.flatnonzero([r[6] for r in rows])
        q, q_ids = x[asks], ids[asks]
        answers = best(q_ids, ids, scores(q, x), k)
        floors = {}
        for query, _, score in answers:
            floors.setdefault(query, []).append(float(score))
        floor = np.array([floors[i][-1] if len(floors.get(i, [])) == k else -np.inf for i in q_ids.tolist()])
        near = pivots.get(dimension, np.zeros((0, dimension)))
        to_pivots = distances(q, near) if len(q) and len(near) else np.zeros((len(q), max(len(near), 1)))
        reach = [{"pivot": j, "low": float(to_pivots[:, j].min()), "high": float(to_pivots[:, j].max())}
                 for j in range(to_pivots.shape[1])] if len(q) else []
        kind, small = packed(x)
        return (block, dimension, pivot, float(apart.min()), float(apart.max()), float(norms.max()), kind,
                ids.tobytes(), np.array([r[5] for r in rows], np.int64).tobytes(), small.tobytes(), q_ids.tobytes(), small[asks].tobytes(), floor.tobytes(), len(q_ids),
                float(norms[asks].max()) if len(q) else 0.0, float(floor.min()) if len(q) else 0.0, reach)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, rows = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            out = []
            for row in zip(*[batch.column(c).to_pylist() for c in range(7)], strict=True):
                if rows and (row[2:4] != rows[-1][2:4] or len(rows) >= ring):
                    out.append(close(rows, block))
                    block, rows = block + 1, []
                rows.append(row)
            if out:
                yield _batch(out, arrow)
        if rows:
            yield _batch([close(rows, block)], arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(RINGS))
    return stored(dealt.mapInArrow(cut, RINGS), "topk-rings")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)],
        schema=schema)


def search(embeddings: DataFrame, k: int = K, every: int = EVERY, pivots: int = PIVOTS, sample: int = SAMPLE,
           ring: int = RING) -> DataFrame:
    """query_id, rank, vec_id, score: for every vec_id divisible by `every`, the k best other rows, ties to the
    smaller vec_id; all of them if there are fewer.

    Vectors are floor(256 * x) of each component. Rows whose id is NULL, or whose vector is NULL or holds NULL or
    non-finite components, take no part; only vectors of one length are compared. Rows that carry the query's id are
    left out. A row repeated in id and vector is a candidate as often as it is there, but asks once; of several vectors
    with one id the smallest asks, and all are candidates. Every row is indexed; the bounded sample only places
    the pivots. Blocks of queries meet the rings that their bounds admit, in rounds of joins by block; where bounds
    admit all, that is the stated query set against all rows, in blocks.
    """
    usable = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"),
                               F.col("embedding").cast("array<double>").alias("x")).filter(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall(
            "x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    places = choose_pivots(usable, pivots, sample)
    rings = build_rings(usable, places, k, every, ring)
    asking = rings.filter("q_count > 0").select(
        F.col("block").alias("q_block"), "dimension", F.explode("reach").alias("r"), "q_norm", "q_least").select(
        "q_block", "dimension", "r.pivot", F.col("r.low").alias("q_low"), F.col("r.high").alias("q_high"), "q_norm",
        "q_least")
    known = rings.select("block", "dimension", "pivot", "low", "high", "norm")
    gap = F.greatest(F.lit(0.0), F.col("q_low") - F.col("high"), F.col("low") - F.col("q_high"))
    pairs = asking.join(known, ["dimension", "pivot"]).filter(
        (F.pow("q_norm", F.lit(2)) + F.pow("norm", F.lit(2)) - F.pow(gap, F.lit(2))) / 2 * (1 + SLACK) + 1
        >= F.col("q_least")).select("q_block", "block")
    questions = rings.filter("q_count > 0").select(F.col("block").alias("q_block"), F.col("kind").alias("q_kind"), "q_ids", "q_vectors", "q_floor")
    holds = rings.select("block", "dimension", "pivot", "low", "high", "norm", "kind", "ids", "copies", "vectors")
    met = pairs.join(questions, "q_block").join(holds, "block").select(
        "dimension", "pivot", "low", "high", "norm", "q_kind", "q_ids", "q_vectors", "q_floor", "kind", "ids", "copies", "vectors")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                # One pair of blocks at a time, whatever the batch holds.
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                size = row["dimension"]
                ids = np.frombuffer(row["ids"], np.int64)
                x = np.frombuffer(row["vectors"], row["kind"]).reshape(len(ids), size).astype(float)
                q_ids = np.frombuffer(row["q_ids"], np.int64)
                q = np.frombuffer(row["q_vectors"], row["q_kind"]).reshape(len(q_ids), size).astype(float)
                floor = np.frombuffer(row["q_floor"])
                if size in places and size:
                    apart = distances(q, places[size][row["pivot"]:row["pivot"] + 1])[:, 0]
                    gap = np.maximum(0.0, np.maximum(apart - row["high"], row["low"] - apart))
                    bound = ((q * q).sum(axis=1) + row["norm"] ** 2 - gap ** 2) / 2
                    kept = np.flatnonzero(bound * (1 + SLACK) + 1 >= floor)
                    q, q_ids, floor = q[kept], q_ids[kept], floor[kept]
                found = scores(q, x)
                triples = np.array(best(q_ids, ids, found, k), np.int64).reshape(-1, 3)
                at = triples[:, 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (triples[:, 0], ids[at], triples[:, 2], np.frombuffer(row["copies"], np.int64)[at])],
                    names=["query_id", "vec_id", "score", "copies"])

    found = met.mapInArrow(answer, ANSWER)
    each = found.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
