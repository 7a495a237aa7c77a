import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioframe.llm import packing
from folioframe.llm.common import read_table
from folioframe.llm.queries import vocabulary
from tests.llm.helpers import SF, awkward, documents, with_clashes


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary()[0])


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def hold(packed, rows, tokenizer, window=1024):
    """Every id lies in one piece, sequences are gapless and no longer than a window."""
    expected = {}
    for doc_id, text in rows:
        expected.setdefault(doc_id, []).append(np.array(ids_of(tokenizer, text), "<u4"))
    pieces, sequences = {}, {}
    for r in packed:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces.keys() == expected.keys()
    for doc_id, copies in expected.items():
        want = sorted((s, len(ids[s:s + window]), zlib.crc32(ids[s:s + window].tobytes()), len(ids))
                      for ids in copies for s in range(0, len(ids), window))
        assert sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces[doc_id]) == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return sequences


def plain_best_fit(sizes, capacity):
    free, placed = [], []
    for size in sizes:
        fits = [(f, k) for k, f in enumerate(free) if f >= size]
        if fits:
            k = min(fits)[1]
            placed.append(capacity - free[k])
            free[k] -= size
        else:
            free.append(capacity - size)
            placed.append(0)
    return len(free), placed


def test_segment_tree_against_a_plain_search():
    rng = random.Random(1)
    for capacity in (1, 7, 100, 1024):
        sizes = sorted((rng.randint(1, capacity) for _ in range(400)), reverse=True)
        tree = packing.BestFit(capacity)
        offsets = [tree.place(s)[1] for s in sizes]
        windows, expected = plain_best_fit(sizes, capacity)
        assert (tree.windows, offsets) == (windows, expected)


def test_both_libraries_give_the_same_ids(tokenizer):
    encode = packing.encoder(*vocabulary())
    rng = random.Random(2)
    alphabet = "ab Z09 \n\t\r é日本🎉'sdtlm.,!?<|>‍́_-ßİ٣²"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a <|endoftext|> b", " <|endoftext|><|endoftext|>\n\nx", "<|endof text|>", "  <|endoftext|>  é", "", " ", "a" * 5000, "don't we'LL", "�\x00\x1f"]
    for text in texts:
        assert list(encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids, text
        assert list(packing.encoder(vocabulary()[0], "")(text)) == list(encode(text))
    assert list(encode("a <|endoftext|> b")) == [64, 220, 50256, 275]


def test_a_special_token_in_a_text_is_one_id(spark, tokenizer):
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>" * 2000), (3, "<|endoftext|")]
    packed = packing.pack(documents(spark, rows), *vocabulary()).collect()
    hold(packed, rows, tokenizer)
    assert {r["doc_id"]: r["doc_tokens"] for r in packed}[2] == 2001


def test_round_trip_of_the_test_documents(spark, tokenizer):
    table = read_table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    packed = packing.pack(table, *vocabulary()).collect()
    sequences = hold(packed, rows, tokenizer)
    used = sum(n for parts in sequences.values() for _, n in parts)
    assert used > 0.97 * 1024 * len(sequences)


def test_shards_and_small_windows(spark, tokenizer):
    table = read_table(spark, SF, "documents").filter("doc_id < 60")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    hold(packing.pack(table, *vocabulary(), window=64, shard=9).collect(), rows, tokenizer, window=64)


def test_awkward_rows_and_clashing_columns(spark, tokenizer):
    table = with_clashes(awkward(spark))
    rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    hold(packing.pack(table, *vocabulary()).collect(), rows, tokenizer)


def test_empty_table(spark):
    assert packing.pack(documents(spark, [(1, "x")]).filter(F.lit(False)), *vocabulary()).collect() == []
