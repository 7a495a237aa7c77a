"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel over standardised statistics of the whole text. Each task adds up its part
of the normal equations; the parts are summed per matrix row before one matrix of fixed size reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.calibration import Isotonic, fit_binned
from folioframe.llm.common import map_texts, remainder, stored, unit_hash

STATISTICS = (
    "log_chars", "log_words", "word_length", "short_words", "long_words", "distinct_words", "commonest_word",
    "repeated_neighbours", "upper", "digits", "spaces", "sentence_marks", "bars", "symbols", "exclamations",
    "other_marks", "distinct_lines", "line_length", "lines_with_end", "char_entropy",
)
# Characters counted together.
SENTENCE_MARKS, BARS, SYMBOLS, EXCLAMATIONS = ".,;:", "|", "#$%&*<>{}[]\\^~=_", "!?"
OTHER_MARKS = "\"'()-/+@`"
FIELDS = [T.StructField("stats", T.ArrayType(T.DoubleType()))]
LOW, HIGH = -0.5, 1.5


def statistics(text: str) -> list[float]:
    """The numbers of STATISTICS for one text; an empty text gives zeros."""
    words = text.split()
    n, chars = len(words), len(text)
    if not chars:
        return [0.0] * len(STATISTICS)
    counted: dict[str, int] = {}
    for word in words:
        counted[word] = counted.get(word, 0) + 1
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.bincount(np.minimum(codes, 255), minlength=256)
    share = low[low > 0] / chars
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [line for line in text.split("\n") if line.strip()]
    per = 1.0 / max(n, 1)
    marks = [float(sum(low[ord(c)] for c in group)) / chars
             for group in (SENTENCE_MARKS, BARS, SYMBOLS, EXCLAMATIONS, OTHER_MARKS)]
    return [
        np.log1p(chars), np.log1p(n), lengths.mean() if n else 0.0, (lengths <= 3).sum() * per,
        (lengths >= 12).sum() * per, len(counted) / max(n, 1) ** 0.8, max(counted.values(), default=0) * per,
        sum(map(eq, words, words[1:])) * per, low[65:91].sum() / chars, low[48:58].sum() / chars,
        (low[9:14].sum() + low[32]) / chars, marks[0], marks[1], marks[2], marks[3], marks[4],
        len(set(lines)) / max(len(lines), 1), np.log1p(chars / max(len(lines), 1)),
        sum(line.rstrip()[-1] in ".!?" for line in lines) / max(len(lines), 1),
        float(-(share * np.log(share)).sum()),
    ]


@dataclass
class Model:
    """Standardisation, random projection, ridge coefficients and calibration."""

    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    ridge: np.ndarray
    calibrated: Isotonic

    def features(self, stats: np.ndarray) -> np.ndarray:
        flat = np.clip((stats - self.mean) / self.scale, -6.0, 6.0)
        waves = np.cos(flat @ self.projection + self.phase) * np.sqrt(2.0 / self.projection.shape[1])
        return np.hstack([waves, np.ones((len(flat), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.ridge

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return self.calibrated(self.raw(stats))


def labels_by_document(labels: DataFrame, label: str) -> DataFrame:
    """One row per doc_id: the mean of its non-NULL labels, so that repeated label rows count once."""
    return labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.avg(F.col(label).cast("double")).alias("target"))


def stats_matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def normal_equations(train: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y of the rows (stats, target), summed over partitions row of the matrix by row."""
    size = len(model.phase) + 1
    schema = "r int, v array<double>"

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        seen = False
        for batch in batches:
            if batch.num_rows:
                z = model.features(stats_matrix(batch.column(0)))
                total += z.T @ np.hstack([z, batch.column(1).to_numpy()[:, None]])
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["r", "v"])

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"r": [key[0]], "v": [np.sum(np.stack(frame["v"]), axis=0)]})

    rows = train.select("stats", "target").mapInArrow(part, schema).groupBy("r").applyInPandas(add, schema).collect()
    total = np.zeros((size, size + 1))
    for row in rows:
        total[row["r"]] = row["v"]
    return total[:, :-1], total[:, -1]


def fit(train: DataFrame, waves: int = 256, width: float = 0.05, penalty: float = 1e-3, seed: int = 11) -> Model:
    """Fit on the rows (doc_id, stats, target). `width` is the kernel's gamma on standardised statistics, `penalty`
    the ridge term per training row. One document in four is left for the calibration. No rows: score 0.5."""
    size = len(STATISTICS)
    moments = train.agg(*[f(F.col("stats")[i]).alias(f"{n}{i}") for i in range(size)
                          for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    rng = np.random.default_rng(seed)
    empty = Isotonic(np.empty(0), np.empty(0))
    model = Model(
        np.array([moments[f"m{i}"] or 0.0 for i in range(size)]),
        np.array([max(moments[f"s{i}"] or 0.0, 1e-6) for i in range(size)]),
        rng.normal(0.0, np.sqrt(2.0 * width), (size, waves)), rng.uniform(0.0, 2.0 * np.pi, waves),
        np.zeros(waves + 1), empty,
    )
    marked = train.withColumn("held", unit_hash("doc_id", seed="calibrate") < 0.25)
    left, right = normal_equations(marked.filter(~F.col("held")), model)
    model.ridge = np.linalg.solve(left + np.eye(waves + 1) * (penalty * max(left[-1, -1], 1.0)), right)
    raw_only = score_rows(marked.filter("held"), ["target"], "stats", lambda m: {"raw": model.raw(m)}, ["raw"])
    model.calibrated = fit_binned(raw_only, "raw", "target", LOW, HIGH)
    return model


def score_rows(df: DataFrame, keep: list[str], stats: str, work, names: list[str]) -> DataFrame:
    """`keep` columns beside double columns that `work` makes of each batch's matrix of statistics."""
    source = df.select(*keep, stats)
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(n, T.DoubleType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            width = len(column[0]) if len(column) else 1
            made = work(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width))
            yield pa.RecordBatch.from_arrays(
                list(batch.columns[:-1]) + [pa.array(np.asarray(made[n], float)) for n in names], names=[*keep, *names])

    return source.mapInArrow(run, schema)


def score(documents: DataFrame, labels: DataFrame, waves: int = 256) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5) and raw for every row of `documents`.

    Learns from labelled rows whose crc32(doc_id) mod 3 is not 1. NULL texts count as empty; empty texts get the
    score of their statistics (all zero). A row with a NULL id is scored, not learned from, and not held out. Labels
    that are NULL are left out, repeated ones averaged. Without labels every score is 0.5. Statistics are computed
    once and stored (doc_id and 20 numbers a row); only that table is joined with the labels.
    """
    table = stored(
        map_texts(documents, ["doc_id"], lambda texts: {"stats": [statistics(t) for t in texts]}, FIELDS),
        "quality-statistics")
    train = table.filter(remainder("doc_id", 3) != 1).join(labels_by_document(labels, "quality"), "doc_id")
    model = fit(train.select("doc_id", "stats", "target"), waves)
    scored = score_rows(table, ["doc_id"], "stats",
                        lambda m: {"raw": (r := model.raw(m)), "score": model.calibrated(r)}, ["raw", "score"])
    return scored.select(
        "doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "raw")
