import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import secrets
from folioframe.llm.common import read_table
from folioframe.llm.queries import op4_secret_crf
from tests.llm.helpers import SF, awkward, documents, with_clashes
from tests.llm.test_spans import plain_secrets


def test_base_spans_of_the_test_documents(spark):
    table = read_table(spark, SF, "documents")
    found = {r["doc_id"]: r for r in op4_secret_crf(spark, SF).collect()}
    for row in table.collect():
        plain = plain_secrets(row["text"])
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in plain)
        got = found[row["doc_id"]]
        assert got["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(got["spans"].split(","))
        assert [got[f"n_{k}"] for k in secrets.KINDS] == [sum(s[2] == k for s in plain) for k in secrets.KINDS]


def plain_viterbi(field, index):
    transitions, start = field.allowed()
    emission = field.weights[index].sum(axis=1)
    score, back = start + emission[0], []
    for row in emission[1:]:
        reach = score[:, None] + transitions
        back.append(reach.argmax(axis=0))
        score = reach.max(axis=0) + row
    tags = [int(score.argmax())]
    for step in reversed(back):
        tags.append(int(step[tags[-1]]))
    return tags[::-1], score.max()


def path_score(field, index, tags):
    transitions, start = field.allowed()
    emission = field.weights[index].sum(axis=1)
    return start[tags[0]] + sum(emission[i, t] for i, t in enumerate(tags)) + sum(
        transitions[a, b] for a, b in zip(tags, tags[1:]))


@pytest.mark.parametrize("seed", range(80))
def test_cut_chains_decode_like_whole_ones(seed):
    rng = np.random.default_rng(seed)
    field = secrets.Field(rng.normal(0, rng.choice([0.3, 1, 4]), (secrets.SIZE, 3)), rng.normal(0, 1, (3, 3)),
                          rng.normal(0, 1, 3))
    field.weights[:, 0] += rng.choice([0, 0.5, 2])
    index = np.stack([rng.integers(0, n, 50) for n in secrets.RANGES.values()], 1) + secrets.OFFSETS
    index = index[:rng.integers(1, 50)]
    tags = secrets.viterbi(field, index)
    assert path_score(field, index, list(map(int, tags))) == pytest.approx(plain_viterbi(field, index)[1])


def test_tokens_are_the_runs_between_separators():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("ab 1A=\"\n:é日🎉-") for _ in range(rng.randrange(30)))
        starts, ends, index = secrets.tokens(text)
        cut = "".join(" " if c in secrets.SEPARATORS else c for c in text)
        assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == [w for w in cut.split(" ") if w]
        assert index.shape == (len(starts), len(secrets.RANGES))
        for k, width in enumerate(secrets.RANGES.values()):
            assert ((index[:, k] >= secrets.OFFSETS[k]) & (index[:, k] < secrets.OFFSETS[k] + width)).all()


def test_equal_words_have_equal_hashes_wherever_they_stand():
    _, _, index = secrets.tokens("x Token y token  z")
    assert index[2, list(secrets.RANGES).index("previous")] != index[0, list(secrets.RANGES).index("previous")]
    _, _, a = secrets.tokens("token abc")
    _, _, b = secrets.tokens("some more words before token abc")
    at = list(secrets.RANGES).index("previous")
    assert a[1, at] == b[5, at]


def test_training_raises_the_likelihood_of_the_tags():
    rng = np.random.default_rng(0)
    index = np.zeros((40, secrets.WINDOW, len(secrets.RANGES)), np.int32)
    tags = np.zeros((40, secrets.WINDOW), np.int8)
    for w in range(40):
        index[w] = np.stack([rng.integers(0, n, secrets.WINDOW) for n in secrets.RANGES.values()], 1) + secrets.OFFSETS
        at = rng.integers(1, 30)
        index[w, :, 0] = secrets.OFFSETS[0] + 1
        index[w, at:at + 2, 0] = secrets.OFFSETS[0] + 7
        tags[w, at], tags[w, at + 1] = 1, 2
    tags[0, 35:] = -1
    field = secrets.train(index, tags)
    wrong = sum((secrets.viterbi(field, index[w][tags[w] >= 0]) != tags[w][tags[w] >= 0]).sum() for w in range(40))
    assert wrong == 0


def test_untaught_field_tags_nothing():
    field = secrets.train(np.zeros((0, secrets.WINDOW, len(secrets.RANGES)), np.int32),
                          np.zeros((0, secrets.WINDOW), np.int8))
    assert secrets.find_in(field, ["some plain words", ""])["learned"] == [[], []]


def test_redaction():
    assert secrets.redact_text("abcdefghij", [(1, 3), (2, 5), (7, 8)], "#") == "a#fg#ij"
    assert secrets.redact_text("abc", [], "#") == "abc"


def test_redacted_documents_hold_no_secret(spark):
    table = read_table(spark, "/root/testdata/sf0.01", "documents")
    clean = {r["doc_id"]: r for r in secrets.redact(table).collect()}
    changed = 0
    for row in table.collect():
        got = clean[row["doc_id"]]
        assert not plain_secrets(got["text"].replace("<secret>", "\n")) and got["n_chars"] == len(got["text"])
        assert bool(plain_secrets(row["text"])) <= (got["text"] != row["text"])
        changed += got["text"] != row["text"]
    assert 0 < changed < 0.2 * len(clean)


def test_awkward_rows_and_clashing_columns(spark):
    table = with_clashes(awkward(spark)).unionByName(
        with_clashes(documents(spark, [(20, "password=abcdefgh1"), (20, "password=abcdefgh1")])))
    found = secrets.find(table, ["doc_id"]).collect()
    assert len(found) == table.count()
    assert [len(r["base"]) for r in found if r["doc_id"] == 20] == [1, 1]
    redacted = secrets.redact(table)
    assert redacted.columns == table.columns and redacted.count() == table.count()
    rows = redacted.collect()
    assert [r["text"] for r in rows if r["doc_id"] == 20] == ["<secret>"] * 2
    assert [r["text"] for r in rows if r["doc_id"] == 1] == [None]
    assert redacted.drop("n_chars").count() == table.count()


def test_empty_table(spark):
    nothing = documents(spark, [(1, "x")]).filter(F.lit(False))
    assert secrets.find(nothing, ["doc_id"]).collect() == [] and secrets.redact(nothing).collect() == []


def test_looks_learned_from_the_rules_find_what_the_rules_miss(spark):
    rng = random.Random(8)

    def word():
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))

    def hexes(n):
        return "".join(rng.choice("0123456789abcdef") for _ in range(n))

    rows = []
    for i in range(240):
        words = [word() for _ in range(30)]
        words[rng.randrange(30)] = rng.choice([f"password={hexes(20)}", f'token = "{hexes(24)}"', str(rng.randrange(10**9)), word()])
        rows.append((i, " ".join(words)))
    text = f"{word()} {word()} passphrase {hexes(20)} {word()} 1234567890 {word()}"
    start = text.index("passphrase ") + len("passphrase ")
    found = {r["doc_id"]: r for r in secrets.find(documents(spark, [*rows, (999, text)]), ["doc_id"]).collect()}
    assert found[999]["base"] == [] and [(s["start"], s["end"]) for s in found[999]["learned"]] == [(start, start + 20)]
    clean = [i for i, t in rows if not plain_secrets(t)]
    assert sum(bool(found[i]["learned"]) for i in clean) == 0


def test_every_secret_of_a_training_text_lies_in_a_window():
    filler = " ".join(f"word{i}" for i in range(300))
    text = f"password = first-secret-1 {filler} token: {'ab' * 10} {filler} secret=last-secret-99"
    starts, ends, _ = secrets.tokens(text)
    made = secrets.windows(text, 0.5)
    assert len(made) == 3 and all(len(tags) == secrets.WINDOW and tags.any() for _, tags in made)
    # The chain begins a secret where it starts inside one.
    assert all(tags[0] != 2 for _, tags in made)
    dense = " ".join(f"token=secret-number-{i}" for i in range(200))
    covered = sum(int((tags > 0).sum()) for _, tags in secrets.windows(dense, 0.5))
    assert covered >= 200
    assert len(secrets.windows("no secret 1 here", 0.5)) == 1 and secrets.windows(" ", 0.5) == []


def test_a_second_secret_far_from_the_first_is_learned_from(spark):
    """The word before the later secrets is met nowhere else: without their windows it would mean nothing."""
    rng = random.Random(12)

    def value():
        return "".join(rng.choice("ghjkmnpqrstvwxyz23456789GHJKMNPQ") for _ in range(20))

    filler = " ".join(["plain"] * 120)
    rows = [(i, f"password={value()} {filler} the passwd: {value()} was zzkey now") for i in range(60)]
    rows += [(100 + i, f"{filler} some report of numbers {i} and more") for i in range(60)]
    field = secrets.fit(documents(spark, rows))
    windows = [w for _, text in rows[:60] for w in secrets.windows(text, 0.5)]
    assert len(windows) == 120
    tags = [secrets.viterbi(field, index) for index, _ in windows]
    right = sum((found == want).all() for found, (_, want) in zip(tags, windows, strict=True))
    assert right > 0.9 * len(windows)


def test_a_column_called_like_the_operators_own_is_kept(spark):
    table = documents(spark, [(1, "password=abcdefgh12"), (2, None)]).select("*", F.lit("mine").alias("changed"), F.lit("too").alias("__changed"))
    rows = secrets.redact(table).orderBy("doc_id").collect()
    assert [(r["changed"], r["__changed"]) for r in rows] == [("mine", "too")] * 2 and "<secret>" in rows[0]["text"] and rows[1]["text"] is None
