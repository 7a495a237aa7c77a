"""Language identification by error-correcting output codes over character trigrams.

Every learned language has a codeword of -1 / +1 bits. One binary naive Bayes classifier per bit, over hashed
trigrams, tells the languages whose bit is +1 from the others. A document's bit margins are decoded to the codeword
with the least weighted logistic loss; the softmax of the negated losses is the score.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.common import map_texts, remainder, unit_hash

BUCKET_BITS = 14
SLICE = 1024
UNKNOWN = "und"
# Texts are hashed in stretches of so many characters, to bound memory.
STRETCH = 1 << 20
FIELDS = [
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("ambiguous", T.BooleanType()),
]


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray    # languages x bits, -1 or +1
    weights: np.ndarray  # buckets x bits, log odds of a trigram for +1
    bit_weights: np.ndarray
    letters: np.ndarray  # per code point: is it a letter


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """Up to seven languages: every split of them in two. More: the best separated of 200 random codes, of
    10 log2 k bits."""
    if k < 2:
        return np.ones((k, 0))
    if k <= 7:
        splits = np.arange(1, 2 ** (k - 1))
        return np.array([np.where(splits >> max(0, j - 1) & (j > 0), -1.0, 1.0) for j in range(k)])
    rng, best, apart = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (k, math.ceil(10 * math.log2(k))))
        if (np.abs(code.sum(axis=0)) == k).any():
            continue
        near = code @ code.T
        np.fill_diagonal(near, -np.inf)
        if (distance := (code.shape[1] - near.max()) / 2) > apart:
            best, apart = code, distance
    return best


def trigram_buckets(text: str, letters: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket of each trigram of the lower-cased text, anything but letters read as a blank, in bounded stretches."""
    text = " " + text.lower() + " "
    for start in range(0, len(text), STRETCH):
        piece = text[start:start + STRETCH + 2]
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(letters[codes], codes, np.uint32(32))
        if len(codes) < 3:
            continue
        mixed = codes[:-2] * np.uint32(2654435761) + codes[1:-1] * np.uint32(40503) * np.uint32(65599)
        mixed = (mixed ^ (mixed >> np.uint32(15))) + codes[2:] * np.uint32(2246822519)
        mixed ^= mixed >> np.uint32(13)
        mixed *= np.uint32(3266489917)
        blank = (codes[:-2] == 32) & (codes[1:-1] == 32)
        yield (mixed >> np.uint32(32 - BUCKET_BITS))[~blank]


def fit(documents: DataFrame, rows_per_language: int = 8000) -> Model:
    """Learn from rows whose crc32(doc_id) mod 3 is not 1 and whose lang is not NULL.

    At most about `rows_per_language` rows of each language are used, chosen by a hash of the id; that bound keeps
    the fit the same size for any corpus. Counts of trigrams are summed within tasks, then per language and slice of
    buckets; only one count vector per language reaches the driver.
    """
    labelled = documents.filter((remainder("doc_id", 3) != 1) & F.col("lang").isNotNull())
    totals = {r["lang"]: r["count"] for r in labelled.groupBy(F.col("lang").cast("string")).count().collect()}
    languages = sorted(totals)
    letters = letter_table()
    if not languages:
        return Model([], np.ones((0, 0)), np.zeros((1 << BUCKET_BITS, 0)), np.zeros(0), letters)
    rate = F.create_map(*[F.lit(x) for lang in languages for x in (lang, rows_per_language / totals[lang])])
    sample = labelled.withColumn("rate", rate[F.col("lang").cast("string")]).filter(
        unit_hash("doc_id", seed="langid") < F.col("rate")
    ).select(F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "lang string, part int, counts array<bigint>"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letter_table()
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                vector = counts.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                for buckets in trigram_buckets(text, table):
                    vector += np.bincount(buckets, minlength=1 << BUCKET_BITS)
        for lang, vector in counts.items():
            parts = vector.reshape(-1, SLICE)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(parts)), pa.array(range(len(parts)), pa.int32()),
                 pa.array(list(parts), pa.list_(pa.int64()))], names=["lang", "part", "counts"])

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [key[0]], "part": [key[1]], "counts": [np.sum(np.stack(frame["counts"]), axis=0)]})

    found = sample.mapInArrow(count, schema).groupBy("lang", "part").applyInPandas(add, schema).collect()
    counts = np.zeros((len(languages), 1 << BUCKET_BITS))
    for row in found:
        counts[languages.index(row["lang"]), row["part"] * SLICE:(row["part"] + 1) * SLICE] = row["counts"]
    codes = codewords(len(languages))
    shares = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    weights, separation = np.zeros((1 << BUCKET_BITS, codes.shape[1])), np.zeros(codes.shape[1])
    for bit in range(codes.shape[1]):
        plus, minus = shares[codes[:, bit] > 0].mean(axis=0), shares[codes[:, bit] < 0].mean(axis=0)
        weights[:, bit] = np.log(plus / minus)
        separation[bit] = ((plus - minus) * weights[:, bit]).sum()
    return Model(languages, codes, weights, separation / max(separation.sum(), 1e-12), letters)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its score and the runner-up's score for rows of bit margins; ties go to the first language."""
    losses = np.stack([
        (np.logaddexp(0.0, -margins * code) * model.bit_weights).sum(axis=1) for code in model.codes
    ], axis=1)
    scores = np.exp(losses.min(axis=1, keepdims=True) - losses)
    scores /= scores.sum(axis=1, keepdims=True)
    ordered = np.sort(scores, axis=1)
    second = ordered[:, -2] if scores.shape[1] > 1 else np.zeros(len(scores))
    return scores.argmax(axis=1), ordered[:, -1], second


def predict_texts(model: Model, texts: list[str], ambiguity: float) -> dict[str, list]:
    lang, score, unsure = [], [], []
    margins = np.zeros((len(texts), model.codes.shape[1]))
    for i, text in enumerate(texts):
        total, n = np.zeros(model.codes.shape[1]), 0
        for buckets in trigram_buckets(text, model.letters):
            total += np.bincount(buckets, minlength=1 << BUCKET_BITS) @ model.weights \
                if len(buckets) > 1 << BUCKET_BITS else model.weights[buckets].sum(axis=0)
            n += len(buckets)
        margins[i] = total / math.sqrt(max(n, 1))
    if model.languages:
        best, first, second = decode(model, margins)
    for i, text in enumerate(texts):
        if not model.languages or not any(map(str.isalpha, text)):
            lang.append(UNKNOWN)
            score.append(0.0)
            unsure.append(True)
        else:
            lang.append(model.languages[best[i]])
            score.append(float(first[i]))
            unsure.append(bool(first[i] - second[i] < ambiguity))
    return {"lang_pred": lang, "score": score, "ambiguous": unsure}


def identify(documents: DataFrame, keep: list[str], rows_per_language: int = 8000,
             ambiguity: float = 0.2) -> DataFrame:
    """`keep` columns of `documents` beside `lang_pred`, `score` (0 to 1) and `ambiguous`.

    Needs columns doc_id, text, lang. Whole texts are read, map-side; nothing of lang, source or doc_id enters a
    prediction. A text that is NULL, empty or without a letter gives `und`, score 0 and ambiguous; so does every text
    if no row has a language to learn. A single learned language is always predicted with score 1. `ambiguous`
    marks a lead of less than `ambiguity` over the second language. Repeated rows give repeated results. Columns of
    `keep` with the names of results are replaced.
    """
    model = fit(documents, rows_per_language)
    return map_texts(documents, keep, lambda texts: predict_texts(model, texts, ambiguity), FIELDS)
