import hashlib
import time

from pyspark.sql import functions as F

from folioframe.llm import pii
from folioframe.llm.common import read_table
from tests.llm.helpers import SF, awkward, documents, with_clashes
from tests.llm.test_spans import plain_pii


def test_base_spans_of_the_test_documents(spark):
    table = read_table(spark, SF, "documents")
    found = {r["doc_id"]: r for r in pii.digest(pii.find(table)).collect()}
    for row in table.collect():
        plain = sorted(plain_pii(row["text"]), key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in plain)
        got = found[row["doc_id"]]
        assert got["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(got["spans"].split(","))
        assert [got[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in plain) for k in pii.KINDS]


def test_a_context_learned_from_seeds_finds_what_the_rules_miss(spark):
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "378282246310005", "6011111111111117",
             "3530111333300000", "5105105105105100", "4222222222222"]
    rows = [(i, f"Please charge cardnumber {c} today") for i, c in enumerate(cards)]
    rows += [(100, "Please charge cardnumber 4111111111111112 today"), (101, "we sold 4111111111111112 nails"),
             (102, "Please charge cardnumber 77 today")]
    found = {r["doc_id"]: r for r in pii.digest(pii.find(documents(spark, rows))).collect()}
    assert found[100]["spans"] == "card:25:41" and found[100]["n_card"] == 0 and found[100]["n_added"] == 1
    assert found[101]["spans"] == "" and found[102]["spans"] == ""
    assert all(found[i]["n_card"] == 1 and found[i]["n_added"] == 0 for i in range(len(cards)))


def plain_scores(edges, rounds, smoothing):
    """The rounds on dictionaries."""
    patterns = {p for p, *_ in edges}
    instances = {p: {i for q, i, *_ in edges if q == p} for p in patterns}
    seeds = {(p, k): {i for q, i, kk, _ in edges if q == p and kk == k} for p in patterns for k in pii.KINDS}
    known = {key: found for key, found in seeds.items() if found}
    unknown = {(p, i, k) for p, i, kind, suits in edges if kind is None for k in suits if (p, k) in known}
    confidence = {(p, k): len(s) / (len(instances[p]) + smoothing) for (p, k), s in known.items()}
    for _ in range(rounds):
        score = {}
        for p, i, k in unknown:
            score[i, k] = score.get((i, k), 1.0) * (1 - min(confidence[p, k], 0.999))
        confidence = {(p, k): (len(s) + sum(1 - score[i, kk] for q, i, kk in unknown if (q, kk) == (p, k)))
                      / (len(instances[p]) + smoothing) for (p, k), s in known.items()}
    return confidence


def test_rounds_against_plain_scoring(spark):
    edges = []
    for n in range(60):
        kind = [None, "card", "phone", None, "card"][n % 5]
        edges.append((f"P{n * 7 % 5}", f"i{n % 17}", kind, [kind] if kind else ["card", "phone"]))
    frame = spark.createDataFrame(edges, "pattern string, instance string, kind string, suits array<string>").distinct()
    got = {(r["pattern"], r["kind"]): r["confidence"] for r in pii.score_patterns(frame, 3, 3.0).collect()}
    want = plain_scores([e for e in edges], 3, 3.0)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_awkward_rows_and_clashing_columns(spark):
    table = with_clashes(awkward(spark)).unionByName(with_clashes(documents(spark, [(20, "a@b.co"), (20, "a@b.co")])))
    rows = pii.digest(pii.find(table)).collect()
    assert len(rows) == table.count()
    assert [r["spans"] for r in rows if r["doc_id"] == 20] == ["email:0:6"] * 2
    assert all(r["spans"] == "" for r in rows if r["doc_id"] in (1, 2, 3, 4))


def test_empty_table(spark):
    assert pii.find(documents(spark, [(1, "x")]).filter(F.lit(False))).collect() == []


def test_identifiers_without_four_digits_in_a_row_are_found(spark):
    rows = [(i, f"reach hotline +49 30 55512{i:02} today") for i in range(12)]
    rows += [(20 + i, f"from host 10.20.{i}.4 today") for i in range(12)]
    rows += [(40 + i, f"charge plastic {c} today") for i, c in enumerate([
        "4111111111111111", "5500005555555559", "4012888888881881", "378282246310005", "6011111111111117",
        "3530111333300000", "5105105105105100", "4222222222222"])]
    missed = {100: ("reach hotline", "555-123-987", "phone"), 101: ("reach hotline", "12-34-56-78", "phone"),
              102: ("reach hotline", "030 123 456", "phone"), 103: ("reach hotline", "(030) 123 4567", "phone"),
              104: ("from host", "10.20.30.400", "ip"), 105: ("from host", "01.23.45.67.890", "ip"),
              106: ("charge plastic", "4111 1111 1111 1112", "card"), 107: ("reach hotline", "030 5551234", "phone")}
    rows += [(d, f"{before} {number} today") for d, (before, number, _) in missed.items()]
    rows += [(200, "we sold 030 123 456 nails"), (201, "reach hotline 12 34 today")]
    found = {r["doc_id"]: r for r in pii.digest(pii.find(documents(spark, rows))).collect()}
    for d, (before, number, kind) in missed.items():
        if kind == "ip" and number.startswith("01"):
            continue  # the base rule has its first four numbers
        start = len(before) + 1
        assert found[d]["spans"] == f"{kind}:{start}:{len(before) + 1 + len(number)}", (number, found[d]["spans"])
    assert found[200]["spans"] == "" and found[201]["spans"] == ""


def test_candidates():
    def of(text):
        return [text[a:b] for a, b, _ in pii.candidates(text, pii.base_spans(text)) if pii.suitable(text[a:b])]

    assert of("a 12-34-56-78, b") == ["12-34-56-78"]
    assert of("x 030 1234567 2x") == ["1234567", "030 1234567"]
    assert of("1 " * 200) == [] and of("9" * 100_000) == [] and of("a" * 100_000 + "9") == []


def test_identifiers_and_words_of_any_length(spark):
    """A hundred characters of identifier, context words of a hundred and more, and blanks beyond eighty."""
    word = "hyphen-" * 16 + "word"
    rows = [(i, f"{word}{' ' * (90 + i)}user{i}@mail.example.org today") for i in range(8)]
    rows += [(20 + i, f"please write owner{i}@mail.example.org soon") for i in range(8)]
    long = "o" * 95 + "@localhost"
    rows += [(100, f"{word} somebody@localhost today"), (101, f"please write {long} soon"), (102, f"we like {long} here")]
    found = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(documents(spark, rows))).collect()}
    assert found[100] == f"email:{len(word) + 1}:{len(word) + 1 + len('somebody@localhost')}"
    assert found[101] == f"email:13:{13 + len(long)}" and found[102] == ""


def test_contexts_of_many_identifiers_without_blanks_are_read_once():
    begun = time.process_time()
    made = pii.scan([",".join(f"a{i}@b.co" for i in range(20_000)), "x" * 500_000 + "a@b.co" + "y" * 500_000])
    assert time.process_time() - begun < 20
    assert len(made["base"][0]) == 20_000
    assert pii.patterns("one two a@b.co three", 8, 14) == ["L two", "LL one two", "R three", "LR two three"]
    assert pii.patterns("one, a@b.co", 5, 11) == ["L one"] and pii.patterns("a@b.co", 0, 6) == []
