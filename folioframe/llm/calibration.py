"""Isotonic calibration of raw scores, fitted on counts per score bin so that its size does not grow with the data."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 2000


@dataclass
class Isotonic:
    """A non-decreasing step function from raw score to probability, linear between the steps' centres."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        if not len(self.x):
            return np.full(len(raw), 0.5)
        return np.clip(np.interp(raw, self.x, self.y), 0.0, 1.0)


def score_bin(raw: Column, low: float, high: float) -> Column:
    """Which of the BINS equal parts of [low, high] a raw score falls in; scores outside go to the end parts."""
    clipped = F.least(F.greatest(raw, F.lit(low)), F.lit(high))
    return F.floor((clipped - low) / ((high - low) / BINS)).cast("int")


def fit_binned(scored: DataFrame, raw: str, label: str, low: float, high: float) -> Isotonic:
    """Pool adjacent violators over (sum of labels, rows) of each bin; at most BINS + 1 rows reach the driver."""
    rows = (
        scored.groupBy(score_bin(F.col(raw), low, high).alias("bin"))
        .agg(F.sum(label).alias("hits"), F.count(F.lit(1)).alias("n"), F.avg(raw).alias("x"))
        .orderBy("bin").collect()
    )
    return pool([r["x"] for r in rows], [float(r["hits"]) for r in rows], [float(r["n"]) for r in rows])


def pool(x: list[float], hits: list[float], n: list[float]) -> Isotonic:
    """Isotonic regression of `hits / n` on ascending `x`, weighted by `n`.

    Each block's rate is drawn half a row towards the overall rate, so that no score is exactly 0 or 1. No rows
    give a function that answers 0.5 everywhere.
    """
    if not x:
        return Isotonic(np.empty(0), np.empty(0))
    base = sum(hits) / sum(n)
    blocks: list[list[float]] = []
    for at, h, w in zip(x, hits, n, strict=True):
        blocks.append([h, w, at, at])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            h2, w2, _, last = blocks.pop()
            blocks[-1][0] += h2
            blocks[-1][1] += w2
            blocks[-1][3] = last
    xs, ys = [], []
    for h, w, first, last in blocks:
        rate = (h + 0.5 * base) / (w + 0.5)
        xs += [first, last] if last > first else [first]
        ys += [rate, rate] if last > first else [rate]
    return Isotonic(np.asarray(xs), np.asarray(ys))
