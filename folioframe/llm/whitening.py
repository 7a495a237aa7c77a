"""Whitening by principal components, from a Golub-Kahan-Lanczos bidiagonalisation of the centred vectors.

With X the centred distinct vectors as rows, the method builds orthonormal v_1, v_2, ... (of the vectors' dimension) and
u_1, u_2, ... (one entry a row) so that X V = U B with B upper bidiagonal; B's singular values and right vectors give
X's. A u is never stored: each is X w for a w that the driver knows, and the tasks make its entries anew. One pass
over the rows makes X w, its products with the earlier u's, against which it is orthogonalised, and Xᵀ X w. What
reaches the driver is one number a dimension and step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import stored

SCALE = 256
COMPONENTS = 4
# A triple counts as found when its residual, and a vector as dependent when its length, is this small beside
# the Frobenius norm.
FOUND, DEPENDENT = 1e-13, 1e-10
# Steps that a new start takes at least before it may say that nothing larger is left.
CONFIRMING = 8
# Components that explain less than this share are left out: they are rounding.
NEGLIGIBLE = 1e-12
_MOST = (1 << 63) - 1
Multiply = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, float]]


@dataclass
class Fit:
    """Of the distinct vectors: how many, sums a dimension (exact), unit eigenvectors as rows, eigenvalues, and the
    largest entry by which the whitened covariance departs from the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def quantised(embeddings: DataFrame, ids: list[str]) -> DataFrame:
    """`ids` and `x`, floor(256 * c) of each entry as whole numbers, of the rows whose vector has entries, all finite."""
    x = F.col("embedding").cast("array<double>")
    whole = embeddings.select(*ids, x.alias("x")).filter(F.col("x").isNotNull() & (F.size("x") > 0) & F.forall(
        "x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    return whole.withColumn("x", F.transform("x", lambda v: F.floor(v * SCALE)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers from a list column."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def summed(rows: DataFrame, width: int, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what `work` makes of a block of them: partial sums in tasks, added up by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = work(matrix(batch.column(0), width))
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "part"])

    parts = rows.select("x").mapInArrow(run, "at int, part double").groupBy("at").agg(F.sum("part").alias("part"))
    found = {row["at"]: row["part"] for row in parts.collect()}
    return np.array([found[at] for at in range(len(found))])


def whole_sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """How many rows there are and the exact sum of each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, count = [0] * width, 0
        for batch in batches:
            x = matrix(batch.column(0), width)
            count += len(x)
            small = len(x) == 0 or max(int(x.max()), -int(x.min())) < _MOST // len(x)
            made = x.sum(axis=0).tolist() if small else [sum(map(int, column)) for column in x.T]
            totals = [a + b for a, b in zip(totals, made, strict=True)]
        if count:
            yield pa.RecordBatch.from_pydict(
                {"at": pa.array([*range(width), width], pa.int32()),
                 "part": pa.array([str(total) for total in [*totals, count]])})

    parts = rows.select("x").mapInArrow(run, "at int, part string").groupBy("at").agg(
        F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect()
    found = {row["at"]: int(row["part"]) for row in parts}
    return found.pop(width, 0), [found.get(k, 0) for k in range(width)]


def orthogonal(vector: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """`vector` less its parts along the orthonormal `basis`, taken out twice against rounding."""
    if basis:
        rows = np.array(basis)
        for _ in range(2):
            vector = vector - rows.T @ (rows @ vector)
    return vector


def bidiagonalise(multiply: Multiply, start: np.ndarray, locked: list[np.ndarray], wanted: int, scale: float,
                  floor: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of X, by falling value, and right singular vectors, as rows, orthogonal to the `locked` ones.

    `multiply(w, W)` gives, of u = X w, Xᵀ u, the products of u with the columns of X W, and its squared length.
    `scale` is X's Frobenius norm. Ends once the first `wanted` triples are found, or the space is used up; then all
    triples are exact. With a `floor`, ends early where the largest value surely stays below it, and gives nothing.
    """
    width = len(start)
    vs: list[np.ndarray] = []
    ws, backs = np.zeros((width, 0)), np.zeros((width, 0))  # u_k = X ws[:, k], backs[:, k] = Xᵀ u_k
    b = np.zeros((0, 0))
    coming, coupling = orthogonal(start, locked), 0.0
    while True:
        v = orthogonal(coming / np.linalg.norm(coming), locked + vs)
        v /= np.linalg.norm(v)
        k = len(vs)
        vs.append(v)
        w = v - coupling * ws[:, -1] if k else v
        for _ in range(3):
            back, along, square = multiply(w, ws)
            # u less its parts along the earlier ones; anew where much of it was taken out.
            w, back = w - ws @ along, back - backs @ along
            left_over = square - along @ along
            if along @ along <= 1e-8 * square:
                break
        b = np.pad(b, ((0, 1), (0, 1)))
        if k:
            b[k - 1, k] = coupling
        alpha = float(np.sqrt(max(left_over, 0.0)))
        if alpha <= DEPENDENT * scale:
            # X v lies among the earlier u's, so B is complete.
            break
        b[k, k] = alpha
        ws, backs = np.column_stack([ws, w / alpha]), np.column_stack([backs, back / alpha])
        coming = orthogonal(back / alpha - alpha * v, locked + vs)
        coupling = float(np.linalg.norm(coming))
        if coupling <= DEPENDENT * scale or len(vs) + len(locked) >= width:
            break
        left, values, right = np.linalg.svd(b)
        residual = coupling * np.abs(left[k])
        if k + 1 >= wanted and residual[:wanted].max() <= FOUND * scale:
            return values[:wanted], right[:wanted] @ np.array(vs)
        if floor is not None and k + 1 >= CONFIRMING and values[0] + residual[0] < floor:
            return np.zeros(0), np.zeros((0, width))
    _, values, right = np.linalg.svd(b)
    return values, right @ np.array(vs)


def largest(multiply: Multiply, width: int, wanted: int, scale: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest singular values and right singular vectors of X.

    One start meets one vector of each value only. So the found ones are locked, and the method starts again,
    orthogonal to them, until nothing that is left exceeds the last one wanted.
    """
    random = np.random.default_rng(seed)
    values, vectors = np.zeros(0), np.zeros((0, width))
    while len(values) < width:
        floor = values[wanted - 1] if len(values) >= wanted else None
        more, rows = bidiagonalise(multiply, random.normal(size=width), list(vectors),
                                   max(1, wanted - len(values)), scale, floor)
        if not len(more):
            break
        order = np.argsort(-np.concatenate([values, more]), kind="stable")
        values, vectors = np.concatenate([values, more])[order], np.concatenate([vectors, rows])[order]
        if floor is not None and more[0] <= floor:
            break
    return values[:wanted], vectors[:wanted]


def fit(distinct: DataFrame, width: int, wanted: int = COMPONENTS) -> Fit | None:
    """The components of the given distinct vectors `x`, all of `width` entries; None without rows."""
    n, sums = whole_sums(distinct, width)
    if not n:
        return None
    mean = np.array([float(s) for s in sums]) / n
    trace = float(summed(distinct, width, lambda x: ((x - mean) ** 2).sum(axis=0)).sum()) / n

    def multiply(w: np.ndarray, ws: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def work(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            u = centred @ w
            return np.concatenate([u @ centred, u @ (centred @ ws), [u @ u]])

        made = summed(distinct, width, work)
        return made[:width], made[width:-1], float(made[-1])

    if trace <= 0:
        return Fit(n, sums, np.zeros((0, width)), np.zeros(0), trace, 0.0)
    singular, vectors = largest(multiply, width, min(wanted, width), float(np.sqrt(trace * n)))
    values = singular ** 2 / n
    kept = np.flatnonzero(values > NEGLIGIBLE * trace)
    components, values = vectors[kept], values[kept]
    count = len(kept)

    def spread(x: np.ndarray) -> np.ndarray:
        white = ((x - mean) @ components.T) / np.sqrt(values)
        return (white.T @ white).ravel()

    covariance = summed(distinct, width, spread).reshape(count, count) / n
    return Fit(n, sums, components, values, trace, float(np.abs(covariance - np.eye(count)).max()))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - S)^2 for each row, exact; at most the largest 64-bit number."""
    reach = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums), default=0)
    if reach * reach * x.shape[1] <= _MOST:
        apart = x * n - np.array(sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    return [min(_MOST, sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True))) for row in x.tolist()]


def whiten(embeddings: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of every row whose vector has
    entries, all of them finite.

    The fit is over each distinct vector once; rows repeat as given, and a NULL vec_id stays. Vectors must have one
    length: rows of any other than the commonest length (ties: the longest) are left out like unusable ones. Fewer
    components come out where the vectors span fewer; equal vectors, a single one and an empty table give no rows.
    A deviation beyond 64 bits is given as the largest 64-bit number. Other columns are not read.
    """
    if wanted < 1:
        raise ValueError("wanted is at least 1")
    rows = stored(quantised(embeddings, ["vec_id"]), "whitening-rows")
    common = rows.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), F.desc("width")).first()
    schema = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double")
    if common is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    width = common["width"]
    usable = rows.filter(F.size("x") == width).select(F.col("vec_id").cast("bigint").alias("vec_id"), "x")
    fitted = fit(stored(usable.select("x").distinct(), "whitening-distinct"), width, wanted)
    mean = np.array([float(s) for s in fitted.sums]) / fitted.n
    count = len(fitted.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not count:
                continue
            x = matrix(batch.column(1), width)
            white = ((x - mean) @ fitted.components.T) / np.sqrt(fitted.values)
            size = len(x)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(size), count))),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)),
                pa.array(np.full(size * count, fitted.n, np.int64)),
                pa.array(np.repeat(np.array(deviations(x, fitted.n, fitted.sums), np.int64), count)),
                pa.array(white.ravel()), pa.array(np.tile(fitted.values / fitted.trace, size)),
                pa.array(np.full(size * count, fitted.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable.mapInArrow(run, schema)
