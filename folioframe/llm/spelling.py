"""Spelling variants of a corpus's words, found by PartEnum signatures of their letter multisets.

A word is a binary vector: a dimension for every letter and its first, second, ... occurrence. One inserted or deleted
letter changes one dimension, one replaced letter two. The dimensions are dealt into parts by a hash; vectors that
differ in at most `k` dimensions agree on all but `k` parts at most, so they share one of the signatures made of all
parts but `k`. Words are at most one length apart, so words of one length need `k` = 2, and a word and the next longer
ones `k` = 1. One edit also leaves the first or the last half of the shorter word in place, so a signature holds one
of the halves beside the multiset's parts: artificial words share letters often, and halves tell those apart.
Words of one signature meet in an equi-join and are verified there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import stored

RUN = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMAGE = 97
SHORTEST = 5
FEWEST = 3
RATIO = 2
# Parts of the vector for words of one length (two dimensions may differ) and of neighbouring lengths (one may).
EQUAL_PARTS = 4
NEXT_PARTS = 2


def runs(text: Column, shortest: int = 1) -> Column:
    """The maximal letter runs of a text, A to Z lower-cased, that have at least `shortest` code points."""
    plain = F.octet_length(text) == F.length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(lowered, F.lit(f"{RUN}{{{shortest},}}"), F.lit(0))


def damaged(doc_id: Column, run: Column, every: int = DAMAGE) -> Column:
    """`run` without one code point if `every` divides the crc32 of `<doc_id>:<run>`; which one, that value says."""
    hashed = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (hashed % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(hashed % every == 0, cut).otherwise(run)


def words(documents: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, every: int = DAMAGE) -> DataFrame:
    """word, n: every word of at least `shortest` code points that occurs at least `fewest` times."""
    text = F.col("text").cast("string")
    found = documents.select(F.col("doc_id").alias("d"), F.explode(runs(text, shortest)).alias("r"))
    # Lengths are checked after the aggregate: a filter before it would compute every word twice.
    counted = found.groupBy(damaged(F.col("d"), F.col("r"), every).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.length("word") >= shortest) & (F.col("n") >= fewest))


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-spread bits of each unsigned value (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _part_hashes(dimensions: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """words x `count`: the sum, modulo 2**64, of the hashed dimensions that each part of each word holds."""
    dealt, values = (mixed(dimensions) >> np.uint64(40)) % np.uint64(count), mixed(~dimensions)
    return np.stack([np.add.reduceat(np.where(dealt == k, values, np.uint64(0)), starts) for k in range(count)], axis=1)


def signatures(words: list[str], equal_parts: int = EQUAL_PARTS, next_parts: int = NEXT_PARTS) -> np.ndarray:
    """words x signatures, 64-bit hashes; two words one edit apart have at least one in common. No word is empty.

    A set's hash is the sum of its members' hashes, so all words of a batch are hashed at once.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    starts, owner = ends - sizes, np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(letters))
    # A letter's occurrence is its place among the same letters of its word.
    order = np.lexsort((letters, owner))
    fresh = np.r_[True, (letters[order][1:] != letters[order][:-1]) | (owner[order][1:] != owner[order][:-1])]
    occurrence = place - np.maximum.accumulate(np.where(fresh, place, 0))
    dimensions = letters[order] << np.uint64(32) | occurrence.astype(np.uint64)
    equal, near = (_part_hashes(dimensions, starts, count) for count in (equal_parts, next_parts))
    at = (place - starts[owner]).astype(np.uint64)
    first = np.r_[np.uint64(0), np.cumsum(mixed(mixed(letters) + at))]
    from_end = (ends[owner] - place).astype(np.uint64)
    last = np.r_[np.uint64(0), np.cumsum(mixed(~mixed(letters) + from_end))]

    def halves(shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ends that two words, the shorter one so long, may share: one edit leaves one of them in place."""
        half = shorter // 2
        return first[starts + half] - first[starts], last[ends] - last[ends - half]

    out = []
    # Words of one length; then a word as the shorter one of a pair, and as the longer one.
    for kind, hashes, shorter, apart in (("=", equal, sizes, 2), ("+", near, sizes, 1), ("+", near, sizes - 1, 1)):
        count = hashes.shape[1]
        for side, end in zip("<>", halves(shorter), strict=True):
            for kept in combinations(range(count), count - apart):
                tag = np.uint64(xxhash.xxh64_intdigest(f"{kind}{side}{kept}"))
                out.append(mixed(hashes[:, kept].sum(axis=1, dtype=np.uint64) + mixed(
                    mixed(end ^ tag) + shorter.astype(np.uint64))))
    return np.stack(out, axis=1)


def signed(table: DataFrame) -> DataFrame:
    """signature, word and n: a row for each signature of each word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made = signatures(batch.column(0).to_pylist())
            at = pa.array(np.repeat(np.arange(len(made), dtype=np.int32), made.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(made.ravel().view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)],
                names=["signature", "word", "n"])

    return table.select("word", "n").mapInArrow(run, "signature bigint, word string, n bigint")


def near_pairs(table: DataFrame) -> DataFrame:
    """word, other, other_n: both directions of every pair of words one inserted, deleted or replaced code point
    apart. Candidates are verified inside the join, which Spark may split where a signature is common; only pairs
    that are near leave it. Spark takes the signatures to be as small as the words they are made of, and would broadcast
    what is many times as large."""
    rows = signed(table)
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b.hint("merge"), (F.col("a.signature") == F.col("b.signature")) & (F.col("a.word") < F.col("b.word")) & (
        F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1))
    pairs = met.select(F.col("a.word").alias("x"), F.col("a.n").alias("x_n"), F.col("b.word").alias("y"),
                       F.col("b.n").alias("y_n")).distinct()
    return pairs.select(F.explode(F.array(
        F.struct(F.col("x").alias("word"), F.col("y").alias("other"), F.col("y_n").alias("other_n")),
        F.struct(F.col("y").alias("word"), F.col("x").alias("other"), F.col("x_n").alias("other_n")))).alias("p")
    ).select("p.*")


def roots(forms: DataFrame, limit: int = 64) -> DataFrame:
    """word and root, the end of its chain of forms, for every word with a form.

    Every round doubles the length of chain that a row has followed. A form occurs at least RATIO times as often as
    its word, so chains are shorter than the bits of a count."""
    current = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(limit):
        nexts = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(current.join(nexts, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "spelling-roots")
        if moved.filter("moved").isEmpty():
            break
        current = moved.select("word", "root")
    return current.select("word", "root")


def group(documents: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, every: int = DAMAGE,
          ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of `documents` (doc_id, text).

    A word's form is its near word that occurs most often (ties: the smallest in code-point order), if that one
    occurs at least `ratio` times as often; root is where following forms ends, the word itself if it has none. NULL
    and empty texts hold no word; a NULL doc_id counts as an empty text; repeated rows count each. Texts and words may
    be of any length. Other columns are not read. No documents give no rows.
    """
    if shortest < 2 or ratio < 2:
        raise ValueError("words need 2 code points at least, and a form must occur at least twice as often")
    table = stored(words(documents, shortest, fewest, every), "spelling-words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near_pairs(table).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = stored(table.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best")), "spelling-forms")
    forms = joined.select("word", F.col("best.form").alias("form"), "n", "n_near",
                          (-F.col("best.less")).alias("form_n"))
    ends = roots(forms.filter(F.col("form").isNotNull()))
    return forms.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
