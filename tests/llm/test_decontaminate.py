import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import decontaminate as dec
from folioframe.llm.common import read_table
from tests.llm.helpers import SF, awkward, documents, with_clashes


def plain_tiles(document, item, least):
    """Greedy string tiling by looking at every pair of places, again and again."""
    free_d, free_i, tiles = [True] * len(document), [True] * len(item), []
    while True:
        best = None
        for d in range(len(document)):
            for i in range(len(item)):
                n = 0
                while (d + n < len(document) and i + n < len(item) and document[d + n] == item[i + n]
                       and document[d + n] >= 0 and free_d[d + n] and free_i[i + n]):
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, d, i)
        if best is None:
            return tiles
        tiles.append(best)
        for k in range(best[0]):
            free_d[best[1] + k] = free_i[best[2] + k] = False


@pytest.mark.parametrize("seed", range(60))
def test_tiles_against_plain_tiling(seed):
    rng = random.Random(seed)
    words = rng.choice([2, 3, 6, 40])
    item = [rng.randrange(words) for _ in range(rng.randrange(1, 40))]
    document = [rng.randrange(-1, words) for _ in range(rng.randrange(1, 60))]
    if rng.random() < 0.7:
        cut = rng.randrange(len(item))
        document += item[cut:] + [-1] + item[:cut]
    least = rng.choice([1, 3, 5])
    assert dec.tile(np.array(document), np.array(item), least) == plain_tiles(document, item, least)


def test_window_hashes_tell_windows_apart():
    ids = np.array([1, 2, 3, 1, 2, 3, 4, 0, 0, 1])
    for n in range(1, 11):
        hashes = dec.window_hashes(ids, n)
        windows = [tuple(ids[i:i + n]) for i in range(len(ids) - n + 1)]
        assert len(hashes) == len(windows)
        for a in range(len(windows)):
            for b in range(len(windows)):
                assert (hashes[a] == hashes[b]) == (windows[a] == windows[b])


def plain_pairs(docs, items, threshold=0.8, least=5):
    out = set()
    for doc_id, text in docs:
        for item_id, passage in set(items):
            item = dec.words(passage or "")
            numbers = {w: k for k, w in enumerate(dict.fromkeys(item))}
            need = min(least, len(item))
            if item:
                tiles = plain_tiles([numbers.get(w, -1) for w in dec.words(text or "")], [numbers[w] for w in item], need)
                if sum(t[0] for t in tiles) >= threshold * len(item):
                    out.add((doc_id, item_id, sum(t[0] for t in tiles), len(item), len(tiles)))
    return out


def found_pairs(docs, benchmark, **options):
    return {(r["doc_id"], r["item_id"], r["covered_words"], r["item_words"], r["tiles"])
            for r in dec.contaminated(docs, benchmark, **options).collect()}


PASSAGE = "the quick brown fox jumps over one lazy dog while nine wise owls watch from above"


def test_reordered_changed_and_partial_passages(spark):
    words = PASSAGE.split()
    reordered = " ".join(words[8:]) + " filler text " + " ".join(words[:8])
    half = " ".join(words[:8]) + " and nothing more"
    rows = [(1, "Before. " + PASSAGE.upper() + "! After."), (2, reordered), (3, half), (4, "the quick brown"),
            (5, PASSAGE.replace(" over ", " past ")), (6, "short one here"), (7, "here short one"), (8, PASSAGE + " " + PASSAGE)]
    items = [(10, PASSAGE), (11, "short one"), (12, ""), (13, None), (10, PASSAGE), (14, "!!!")]
    got = found_pairs(documents(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"))
    assert got == plain_pairs(rows, items)
    assert {(d, i) for d, i, *_ in got} == {(1, 10), (2, 10), (5, 10), (6, 11), (7, 11), (8, 10)}


def test_parts_of_the_benchmark_give_the_same(spark):
    docs, bench = read_table(spark, SF, "documents"), read_table(spark, SF, "benchmark")
    whole = found_pairs(docs, bench)
    assert whole and whole == found_pairs(docs, bench, part_bytes=2000)


def test_test_documents_against_plain_tiling(spark):
    docs, bench = read_table(spark, SF, "documents"), read_table(spark, SF, "benchmark")
    hit = found_pairs(docs, bench)
    rows = [(r["doc_id"], r["text"]) for r in docs.filter("n_chars < 700").collect()]
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    assert {p for p in hit if p[0] in dict(rows)} == plain_pairs(rows, items)
    left = {r["doc_id"] for r in dec.clean(docs, bench).collect()}
    assert left == {r["doc_id"] for r in docs.collect()} - {p[0] for p in hit}


def test_awkward_rows_and_clashing_columns(spark):
    table = with_clashes(awkward(spark))
    bench = spark.createDataFrame([(1, "same words in two rows", 1), (None, "no id here", 2), (2, None, 3)],
                                  "item_id bigint, text string, hits int")
    found = dec.contaminated(table, bench).collect()
    assert sorted((str(r["doc_id"]), str(r["item_id"])) for r in found) == [
        ("7", "1"), ("7", "1"), ("8", "1"), ("None", "None")]
    kept = dec.clean(table, bench)
    assert kept.columns == table.columns and kept.count() == table.count() - 4


def test_empty_tables(spark):
    docs = documents(spark, [(1, "a b c d e f")])
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert dec.contaminated(docs.filter(F.lit(False)), bench).collect() == []
    assert dec.contaminated(docs, bench.filter(F.lit(False))).collect() == []
    assert dec.clean(docs, bench.filter(F.lit(False))).count() == 1
