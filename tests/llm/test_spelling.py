import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import spelling
from tests.llm.helpers import SF, awkward, documents, with_clashes

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_edit(a, b):
    """Whether exactly one inserted, deleted or replaced code point tells two words apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain(rows, every=97):
    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    counted = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counted[run] += 1
    words = {w: n for w, n in counted.items() if len(w) >= 5 and n >= 3}
    near = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return out


def got(df, **options):
    rows = [tuple(r[c] for c in COLUMNS) for r in spelling.group(df, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def edited(word, rng):
    letters = "abcdeéèÿzß"
    k, kind = rng.randrange(len(word)), rng.randrange(3)
    return word[:k] + ("" if kind == 0 else rng.choice(letters)) + word[k + (kind != 2):]


def test_words_one_edit_apart_share_a_signature():
    rng = random.Random(3)
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(2, 12)))
        b = edited(a, rng)
        if b and one_edit(a, b):
            x, y = spelling.signatures([a, b])
            assert set(x) & set(y), (a, b)


def test_signatures_do_not_hang_on_the_batch():
    words = ["reading", "reads", "aaaaaa", "ÿÿÿÿÿ", "x" * 3000]
    together = spelling.signatures(words)
    assert all((spelling.signatures([w])[0] == row).all() for w, row in zip(words, together, strict=True))
    assert len(np.unique(together)) > 0.9 * together.size


@pytest.mark.parametrize("every", [97, 7])
def test_against_all_pairs(spark, every):
    rng = random.Random(every)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(5, 9))) for _ in range(60)]
    pool = base + [edited(w, rng) for w in base for _ in range(4)] + ["ABÀba", "abàba", "abÀba"]
    rows = [(i, " ".join(rng.choice(pool).title() if rng.random() < 0.1 else rng.choice(pool) for _ in range(60)))
            for i in range(120)]
    want = plain(rows, every)
    assert got(documents(spark, rows), every=every) == want
    assert any(r[1] for r in want) and any(r[2] != r[1] for r in want if r[1])


def test_given_documents_against_all_pairs(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    assert got(table) == plain(rows)


def test_forms_follow_chains_and_break_ties_in_code_point_order(spark):
    counts = {"chaina": 3, "chainab": 6, "chainabc": 12, "chainabcd": 30, "tiesé": 20, "tiesz": 20, "tiesa": 5}
    text = " ".join(w for w, n in counts.items() for _ in range(n))
    rows = {r["word"]: r for r in spelling.group(documents(spark, [(1, text)]), every=1 << 40).collect()}
    assert rows["chaina"]["root"] == "chainabcd" and rows["chaina"]["form"] == "chainab"
    assert rows["chainabcd"]["root"] == "chainabcd" and rows["chainabcd"]["form"] is None
    assert rows["tiesa"]["form"] == "tiesz" and rows["tiesé"]["form"] is None and rows["tiesa"]["n_near"] == 2


def test_signatures_are_not_broadcast(spark):
    words = spark.createDataFrame([("reading", 9), ("readings", 3)], "word string, n bigint")
    near = spelling.near_pairs(words)
    assert "BroadcastExchange" not in near._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in near.collect()} == {("reading", "readings", 3), ("readings", "reading", 9)}
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()


def test_a_hot_word_and_repeated_rows(spark):
    rows = [(1, "common comman common")] * 300 + [(2, "comman")] * 5 + [(3, "Übung Ãbung ×÷×÷×")] * 3
    assert got(documents(spark, rows)) == plain(rows)


def test_awkward_empty_and_clashing(spark):
    table = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    long = [r for r in rows if r[1] and len(r[1]) == 200_000] * 3
    want = plain(rows + long)
    assert got(documents(spark, rows + long)) == want and any(len(r[0]) > 100_000 for r in want)
    clashing = with_clashes(table).select("*", *[F.lit(1).alias(c) for c in ("word", "n", "form", "root", "d", "r")])
    assert got(clashing) == plain(rows)
    empty = spelling.group(table.filter(F.lit(False)))
    assert empty.columns == COLUMNS and empty.collect() == []
    with pytest.raises(ValueError):
        spelling.group(table, ratio=1)
