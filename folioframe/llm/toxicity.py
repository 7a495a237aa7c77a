"""Toxicity scores: gradient-boosted trees over dense features of the text, calibrated by isotonic regression.

The lexicon whose densities are features is a fixed list of abusive words and the terms that labelled texts teach:
words and beginnings of words that occur in toxic texts and hardly elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.calibration import Isotonic, fit_binned
from folioframe.llm.common import map_texts, remainder, stored, unit_hash
from folioframe.llm.quality import labels_by_document, score_rows

FEATURES = (
    "log_words", "learned_density", "log_learned_hits", "distinct_learned", "lexicon_density", "log_lexicon_hits", "distinct_terms", "densest_window", "second_person",
    "near_second_person", "upper", "capital_words", "exclamations", "questions", "repeated_marks", "symbols",
    "digits", "masked_words", "masked_hits", "word_length",
)
# Abusive words in the languages of the corpora, and words that address the reader.
LEXICON = frozenset("""
    arse asshole bastard bitch bollocks bullshit clown coward creep cretin cunt damn degenerate dick dimwit
    dipshit disgusting douche dumb dumbass dumb fag fatass filth filthy fool freak fuck fucker fucking garbage halfwit
    hateful hideous idiot idiotic idiots imbecile jackass jerk loser losers lowlife lunatic maggot
    moron moronic morons nasty nitwit pathetic prick psycho puke punk repulsive retard retarded rotten
    rubbish savage scum scumbag shit shitty sissy slut skank stupid sucker sucks swine thug traitor trash
    twat twit ugly useless vermin vile wanker weakling weirdo whore worthless wretch wretched
    abruti batard connard connasse debile merde putain salaud salope
    arschloch bloed depp dumm dummkopf fotze hure idioten mistkerl schlampe schwein trottel wichser
    cabron estupido gilipollas idiota imbecil mierda pendejo puta puto zorra
""".split())
SECOND_PERSON = frozenset("""
    you your yours yourself yourselves u ur youre du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes
    vous votre vos usted ustedes tú ti tus vosotros
""".split())
EDGES = ".,;:!?\"'()[]{}<>*_~-…«»“”’|#"
LEET = str.maketrans("013457@$!|", "oieastasii")
MASKED = re.compile(r"(?<!\S)[^\W\d_]+(?:[0-9@$!*|#.\-_]+[^\W\d_]+)+[.,!?]*(?!\S)")
REPEATED_MARKS = re.compile(r"[!?.]{2,}")
STRETCHED = re.compile(r"(.)\1{2,}")
FIELDS = [T.StructField("features", T.ArrayType(T.DoubleType()))]
WINDOW, NEAR = 20, 5
STEMS = (4, 5, 6)


def plain(word: str) -> str:
    """A masked word with digits and signs read as letters, dots and dashes dropped, stretched letters shortened."""
    return STRETCHED.sub(r"\1", word.translate(LEET).replace(".", "").replace("-", "").replace("_", ""))


def is_masked_hit(word: str, lexicon: frozenset) -> bool:
    if "*" in word or "#" in word:
        shape = re.compile("".join("." if c in "*#" else re.escape(c) for c in word) + r"\Z")
        return any(shape.match(term) for term in lexicon if len(term) == len(word))
    return plain(word) in lexicon


@dataclass(frozen=True)
class Terms:
    """Learned terms: whole words, and beginnings of words of the lengths in STEMS."""

    words: frozenset = frozenset()
    stems: frozenset = frozenset()

    def openings(self) -> frozenset:
        """The first letters of all terms, which most words miss at once."""
        return frozenset(t[:STEMS[0]] for t in self.words | self.stems)

    def has(self, word: str) -> bool:
        return word in self.words or any(len(word) > n and word[:n] in self.stems for n in STEMS)


def candidate_terms(text: str) -> set[str]:
    """Distinct words of a text, and their beginnings marked by a trailing `-`."""
    words = {w.strip(EDGES) for w in text.lower().split()}
    return {w for w in words if len(w) >= 3} | {f"{w[:n]}-" for n in STEMS for w in words if len(w) > n}


def features(text: str, lexicon: frozenset = LEXICON, terms: Terms = Terms(),
             openings: frozenset = frozenset()) -> list[float]:
    """The numbers of FEATURES for one text; an empty text gives zeros."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    lower = [w.strip(EDGES) for w in text.lower().split()]
    learned = [i for i, w in enumerate(lower) if w[:STEMS[0]] in openings and terms.has(w)]
    in_lexicon = [i for i, w in enumerate(lower) if w in lexicon]
    hits = sorted({*learned, *in_lexicon})
    masked = [m.group(0).lower().strip(".,!?") for m in MASKED.finditer(text)]
    masked_hits = sum(w not in lexicon and is_masked_hit(w, lexicon) for w in masked)
    second = [i for i, w in enumerate(lower) if w in SECOND_PERSON]
    near, densest = 0, 0
    if hits:
        at = np.asarray(hits)
        densest = int((np.searchsorted(at, at + WINDOW) - np.arange(len(at))).max())
        if second:
            others = np.asarray(second)
            k = np.searchsorted(others, at)
            gap = np.minimum(np.abs(others[np.minimum(k, len(others) - 1)] - at), np.abs(others[np.maximum(k - 1, 0)] - at))
            near = int((gap <= NEAR).sum())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.bincount(np.minimum(codes, 255), minlength=256)
    return [
        float(np.log1p(n)), 100.0 * len(learned) / n, float(np.log1p(len(learned))),
        float(len({lower[i] for i in learned})), 100.0 * len(in_lexicon) / n, float(np.log1p(len(in_lexicon))),
        float(len({lower[i] for i in in_lexicon})),
        float(densest), 100.0 * len(second) / n, 100.0 * near / n, low[65:91].sum() / chars,
        sum(map(str.isupper, words)) / n, 100.0 * low[33] / chars, 100.0 * low[63] / chars,
        100.0 * sum(1 for _ in REPEATED_MARKS.finditer(text)) / n,
        sum(int(low[ord(c)]) for c in "#$%&*@^~|") / chars, low[48:58].sum() / chars, 100.0 * len(masked) / n,
        100.0 * masked_hits / n, chars / n,
    ]


@dataclass
class Trees:
    """Boosted trees of one depth, each a complete binary tree stored in level order."""

    base: float = 0.0
    columns: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for columns, thresholds, leaves in zip(self.columns, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaves)))):
                node = 2 * node + 1 + (x[np.arange(len(x)), columns[node]] > thresholds[node])
            out += leaves[node - len(columns)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64,
          smooth: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss with trees grown level by level on binned columns.

    A node's best split is read from histograms of gradients and curvatures over all columns and bins. One class
    only, or no rows, gives a constant.
    """
    model = Trees()
    rate_of_ones = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model.base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    if len(np.unique(y)) < 2:
        return model
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    # A column that is mostly one value also needs edges among its other values.
    edges = [np.unique(np.concatenate([e, np.quantile(x[x[:, j] > 0, j], np.linspace(0, 1, bins // 2))[:-1] - 1e-9]))
             if (x[:, j] > 0).any() else e for j, e in enumerate(edges)]
    span = max(len(e) for e in edges) + 1
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(width) * span
    out = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-out))
        gradient, curve = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        columns, thresholds = np.zeros(2 ** depth - 1, np.int64), np.full(2 ** depth - 1, np.inf)
        for level in range(depth):
            first, nodes = 2 ** level - 1, 2 ** level
            where = ((node - first)[:, None] * (width * span) + flat).ravel()
            g, h = (np.bincount(where, np.repeat(v, width), nodes * width * span).reshape(nodes, width, span)
                    for v in (gradient, curve))
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl ** 2 / (hl + smooth) + (gt - gl) ** 2 / (ht - hl + smooth) - gt ** 2 / (ht + smooth)
            gain[(hl < 1.0) | (ht - hl < 1.0)] = 0.0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for k in range(nodes):
                j, b = divmod(int(best[k]), span)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    columns[first + k], thresholds[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), columns[node]] > thresholds[node])
        leaf = node - len(columns)
        g, h = (np.bincount(leaf, v, 2 ** depth) for v in (gradient, curve))
        leaves = rate * g / (h + smooth)
        model.columns.append(columns)
        model.thresholds.append(thresholds)
        model.leaves.append(leaves)
        out += leaves[leaf]
    return model


def learn_terms(documents: DataFrame, targets: DataFrame, rows: int = 20_000, least: int = 5,
                purity: float = 0.9) -> Terms:
    """All terms in at least `least` toxic texts, of which at least `purity` of the texts that hold them are toxic.

    Learned from about `rows` labelled texts at most, chosen by a hash of the id, and those alone are joined with
    their labels; that bounds the terms that reach the driver. Tasks count their own texts first. A stem whose beginning
    is a term already adds nothing and is left out.
    """
    rate = rows / max(targets.count(), 1)
    chosen = documents.filter(unit_hash("doc_id", seed="terms") < rate).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = chosen.join(targets.filter(unit_hash("doc_id", seed="terms") < rate), "doc_id").select("text", "target")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for term in candidate_terms(text):
                    entry = seen.setdefault(term, [0, 0])
                    entry[0] += 1
                    entry[1] += target >= 0.5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()),
                 pa.array([v[1] for v in seen.values()], pa.int64())], names=["term", "n", "toxic"])

    found = sample.mapInArrow(count, "term string, n bigint, toxic bigint").groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).filter(
        (F.col("toxic") >= least) & (F.col("toxic") >= F.col("n") * purity)).select("term").collect()
    stems = {r["term"][:-1] for r in found if r["term"].endswith("-") and len(r["term"]) - 1 in STEMS}
    stems = {s for s in stems if not any(s[:n] in stems for n in STEMS if n < len(s))}
    words = {r["term"] for r in found if not r["term"].endswith("-")}
    return Terms(frozenset(w for w in words if not any(w[:n] in stems for n in STEMS if n < len(w))), frozenset(stems))


def fit(train: DataFrame, fit_rows: int = 60_000) -> tuple[Trees, Isotonic]:
    """Trees from about `fit_rows` labelled rows at most, chosen by a hash of the id (the bound on what reaches the
    driver: 20 numbers a row); the calibration from every labelled row of another quarter, by score bins."""
    marked = train.withColumn("held", unit_hash("doc_id", seed="calibrate") < 0.25)
    pool = marked.filter(~F.col("held"))
    rate = fit_rows / max(pool.count(), 1)
    rows = pool.filter(unit_hash("doc_id", seed="boost") < rate).select("features", "target").toPandas()
    x = np.stack(rows["features"]) if len(rows) else np.zeros((0, len(FEATURES)))
    model = boost(x, rows["target"].to_numpy(float))
    raw = score_rows(marked.filter("held"), ["target"], "features", lambda m: {"raw": model.raw(m)}, ["raw"])
    return model, fit_binned(raw, "raw", "target", -8.0, 8.0)


def score(documents: DataFrame, labels: DataFrame, fit_rows: int = 60_000, term_rows: int = 20_000,
          lexicon: frozenset = LEXICON) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3) and raw for every row of `documents`.

    Learns from labelled rows whose crc32(doc_id) mod 4 is not 2. NULL texts count as empty; an empty text gets the
    score of its features (all zero). A row with a NULL id is scored, not learned from, and not held out. NULL labels
    are left out, repeated ones averaged; a mean label of 0.5 counts as 1. Without labels every score is 0.5.
    Features are computed once, map-side, and stored; only that table is joined with all labels.
    """
    targets = labels_by_document(labels, "toxic").filter(remainder("doc_id", 4) != 2).withColumn(
        "target", (F.col("target") >= 0.5).cast("double"))
    terms = learn_terms(documents, targets.filter(unit_hash("doc_id", seed="calibrate") >= 0.25), term_rows)

    def work(texts: list[str]) -> dict[str, list]:
        openings = terms.openings()
        return {"features": [features(t, lexicon, terms, openings) for t in texts]}

    table = stored(map_texts(documents, ["doc_id"], work, FIELDS), "toxicity-features")
    train = table.join(targets, "doc_id")
    trees, calibrated = fit(train.select("doc_id", "features", "target"), fit_rows)
    scored = score_rows(table, ["doc_id"], "features",
                        lambda m: {"raw": (r := trees.raw(m)), "score": calibrated(r)}, ["raw", "score"])
    return scored.select(
        "doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), "raw")
