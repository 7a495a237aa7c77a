"""Benchmark decontamination by greedy string tiling.

Word sequences of `least` words shared by a document and a benchmark item are seeds. Where the seeds could cover
enough of the item, the longest common sequences, found by Karp-Rabin hashes of growing and shrinking length, are
marked one after another without overlap, in any order of passages; the share of the item's words under the tiles is
its coverage.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.common import map_texts

LEAST = 5
THRESHOLD = 0.8
# Text of the benchmark, in bytes, held by a task at once; a larger benchmark is searched part by part.
PART_BYTES = 8 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BLANKED = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_FILTER_BITS = 22
HIT = T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()),
    T.StructField("covered_words", T.LongType()), T.StructField("item_words", T.LongType()),
    T.StructField("tiles", T.LongType()),
])


def words(text: str) -> list[bytes]:
    """Lower-cased words; ASCII punctuation separates like blanks."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_BLANKED).split()


def window_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of every window of `length` ids, each from its predecessor's in effect: the sums are taken
    term by term over whole arrays."""
    count = len(ids) - length + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    values = ids.astype(np.uint64)
    # Binary splitting: the hash of a window is that of its halves joined, so `length` needs log2 passes.
    power, width, partial = _MULTIPLIER, 1, values + np.uint64(1)
    done = 0
    rest = length
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                total = total * power + partial[done:done + count]
                done += width
            rest >>= 1
            if rest:
                partial = partial[:-width] * power + partial[width:]
                power, width = power * power, 2 * width
    return total


def tile(document: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (length, place in the document, place in the item), longest first; ties by place in the document,
    then in the item. Ids below zero match nothing."""
    free_d, free_i = document >= 0, item >= 0
    tiles: list[tuple[int, int, int]] = []
    size = min(len(document), len(item))
    while size >= least:
        found = _matches(document, item, free_d, free_i, size)
        if not found:
            size = max(least, size // 2) if size > least else 0
            continue
        longest = max(found)[0]
        if longest > 2 * size:
            size = longest
            continue
        for length, d, i in sorted(m for m in found if m[0] == longest):
            if free_d[d:d + length].all() and free_i[i:i + length].all():
                free_d[d:d + length] = False
                free_i[i:i + length] = False
                tiles.append((length, d, i))
        if not free_i.any():
            break
    return tiles


def _matches(document: np.ndarray, item: np.ndarray, free_d: np.ndarray, free_i: np.ndarray,
             size: int) -> list[tuple[int, int, int]]:
    """Maximal common runs of unmarked ids of at least `size`."""
    hashes_d, hashes_i = window_hashes(document, size), window_hashes(item, size)
    open_d = np.convolve(free_d, np.ones(size, int), "valid") == size
    open_i = np.convolve(free_i, np.ones(size, int), "valid") == size
    places: dict[int, list[int]] = {}
    for i in np.flatnonzero(open_i):
        places.setdefault(int(hashes_i[i]), []).append(int(i))
    candidates = np.flatnonzero(open_d & np.isin(hashes_d, hashes_i[open_i]))
    found, reached = [], {}
    for d in map(int, candidates):
        for i in places[int(hashes_d[d])]:
            # A run already followed along this diagonal.
            if reached.get(i - d, -1) > d:
                continue
            most = min(len(document) - d, len(item) - i)
            same = (document[d:d + most] == item[i:i + most]) & free_d[d:d + most] & free_i[i:i + most]
            length = most if same.all() else int(same.argmin())
            reached[i - d] = d + length
            if length >= size:
                found.append((length, d, i))
    return found


@dataclass
class Index:
    """A part of the benchmark: word numbers, and where each seed's hash occurs."""

    vocabulary: dict[bytes, int]
    items: list[tuple[int | None, np.ndarray]]
    hashes: np.ndarray  # sorted
    owners: np.ndarray
    places: np.ndarray
    least: int
    short: dict[int, list[int]]  # items of fewer words than `least`, by their number of words

    @staticmethod
    def build(rows: list[tuple[int | None, str | None]], least: int) -> Index:
        vocabulary: dict[bytes, int] = {}
        items = []
        for item_id, text in rows:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text or "")]
            if ids:
                items.append((item_id, np.array(ids, np.int64)))
        hashes = [window_hashes(ids, min(least, len(ids))) for _, ids in items]
        owners = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        places = np.concatenate([np.arange(len(h)) for h in hashes]) if items else np.empty(0, np.int64)
        flat = np.concatenate(hashes) if items else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        short: dict[int, list[int]] = {}
        for k, (_, ids) in enumerate(items):
            if len(ids) < least:
                short.setdefault(len(ids), []).append(k)
        return Index(vocabulary, items, flat[order], owners[order], places[order], least, short)

    def filter(self) -> np.ndarray:
        table = np.zeros(1 << _FILTER_BITS, bool)
        table[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True
        return table

    def hits(self, text: str, threshold: float, table: np.ndarray) -> list[dict]:
        found = words(text)
        ids = np.fromiter(map(self.vocabulary.get, found, repeat(-1)), np.int64, len(found))
        out: list[dict] = []
        for length in sorted({self.least, *self.short}):
            out += self._hits(ids, length, threshold, table)
        return out

    def _hits(self, ids: np.ndarray, length: int, threshold: float, table: np.ndarray) -> list[dict]:
        if len(ids) < length or not self.items:
            return []
        hashes = window_hashes(ids, length)
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        known = unknown[length:] == unknown[:-length]
        at = np.flatnonzero(known & table[hashes >> np.uint64(64 - _FILTER_BITS)])
        low = np.searchsorted(self.hashes, hashes[at], side="left")
        high = np.searchsorted(self.hashes, hashes[at], side="right")
        at, low, high = at[high > low], low[high > low], high[high > low]
        if not len(at):
            return []
        seen: dict[int, tuple[list[int], list[int]]] = {}
        for d, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
            for k in range(a, b):
                entry = seen.setdefault(int(self.owners[k]), ([], []))
                entry[0].append(d)
                entry[1].append(int(self.places[k]))
        out = []
        for owner, (in_document, in_item) in sorted(seen.items()):
            item_id, item = self.items[owner]
            if min(self.least, len(item)) != length:
                continue
            covered = np.zeros(len(item) + 1, np.int64)
            np.add.at(covered, in_item, 1)
            np.add.at(covered, np.array(in_item) + length, -1)
            # Tiles lie within seeds: what the seeds touch bounds the coverage.
            if (np.cumsum(covered)[:-1] > 0).sum() < threshold * len(item):
                continue
            tiles = tile(self._stretches(ids, in_document, length), item, length)
            words_covered = sum(t[0] for t in tiles)
            if words_covered >= threshold * len(item):
                out.append({"item_id": item_id, "coverage": words_covered / len(item),
                            "covered_words": words_covered, "item_words": len(item), "tiles": len(tiles)})
        return out

    @staticmethod
    def _stretches(ids: np.ndarray, starts: list[int], length: int) -> np.ndarray:
        """The document's words under the seeds, with a gap between stretches that do not touch."""
        under = np.zeros(len(ids) + 1, np.int64)
        np.add.at(under, starts, 1)
        np.add.at(under, np.array(starts) + length, -1)
        keep = np.cumsum(under)[:-1] > 0
        first = np.flatnonzero(keep & ~np.concatenate([[False], keep[:-1]]))
        return np.insert(np.where(keep, ids, -1)[keep], np.searchsorted(np.flatnonzero(keep), first), -1)


def parts(benchmark: DataFrame, least: int, part_bytes: int) -> Iterator[Index]:
    """The benchmark's indexes, each of about `part_bytes` of text, so that what a task holds does not grow."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // part_bytes))
    for k in range(count):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).distinct()
        collected = part.orderBy("item_id", "text").collect()
        yield Index.build([(r["item_id"], r["text"]) for r in collected], least)


def annotate(documents: DataFrame, benchmark: DataFrame, keep: list[str], name: str = "hits",
             threshold: float = THRESHOLD, least: int = LEAST, part_bytes: int = PART_BYTES) -> DataFrame:
    """`keep` columns and `text` beside `name`: the benchmark items (item_id, coverage, covered_words, item_words,
    tiles) of which at least `threshold` of the words lie under tiles of at least `least` words.

    An item of fewer words than `least` is met only by all its words in a row; an item without words, or NULL, by
    nothing. Repeated items count once. NULL and empty texts have no hits; repeated rows each get their hits.
    Map-side over whole texts: only the benchmark travels, in parts of bounded size.
    """
    columns = list(dict.fromkeys([*keep, "text"]))
    frame, made = documents.select(*[F.col(f"`{c}`") for c in columns]), []
    for k, index in enumerate(parts(benchmark, least, part_bytes)):
        made.append(f"__hits{k}")
        columns.append(made[-1])

        def work(texts: list[str], index: Index = index, column: str = made[-1]) -> dict[str, list]:
            table = index.filter()
            return {column: [index.hits(text, threshold, table) for text in texts]}

        frame = map_texts(frame, frame.columns, work, [T.StructField(made[-1], T.ArrayType(HIT))])
    return frame.select(*[F.col(f"`{c}`") for c in columns if c not in made], F.concat(*made).alias(name))


def contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, coverage, covered_words, item_words and tiles of every contaminated document and item."""
    found = annotate(documents, benchmark, ["doc_id"], "__hits", **options)
    return found.select("doc_id", F.explode("__hits").alias("h")).select("doc_id", "h.*")


def clean(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows and columns of `documents` that hold no benchmark item."""
    found = annotate(documents, benchmark, documents.columns, "__hits", **options)
    return found.filter(F.size("__hits") == 0).select(*[F.col(f"`{c}`") for c in documents.columns])
