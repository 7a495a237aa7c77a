"""The pipeline, stage by stage, against plain versions that share no code with the operators' Spark side."""

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from folioframe.llm import langid, secrets
from folioframe.llm.common import read_table
from folioframe.llm.queries import vocabulary
from tests.llm.helpers import SF, awkward, with_clashes
from tests.llm.test_decontaminate import plain_pairs
from tests.llm.test_jaccard import plain_kept
from tests.llm.test_packing import hold
from tests.llm.test_secrets import plain_secrets


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = read_table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        rows = made.collect()
        out.append((docs, made, rows))
        docs = spark.createDataFrame(rows, made.schema)
    return out


def texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_all_but_the_last_stage_keep_the_columns(steps):
    assert 4 <= len(steps) <= 5
    for docs, made, _ in steps[:-1]:
        assert made.dtypes == docs.dtypes


def test_language_stage(steps):
    docs, _, rows = steps[0]
    assert texts(rows) == {d: t for d, t in texts(docs.collect()).items() if any(map(str.isalpha, t or ""))}


def test_language_stage_names_the_language_of_documents_without_one(spark):
    table = read_table(spark, SF, "documents")
    given = {r["doc_id"]: r["lang"] for r in table.collect()}
    blank = table.withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    kept = {r["doc_id"]: r["lang"] for r in corpus_pipeline.known_language(spark, blank, SF).collect()}
    assert all(kept[d] == given[d] for d in kept if d % 3 and given[d] is not None)
    asked = [d for d in kept if d % 3 == 0 and given[d] is not None]
    assert None not in kept.values() and sum(kept[d] == given[d] for d in asked) > 0.9 * len(asked)


def test_near_duplicate_stage(steps):
    docs, _, rows = steps[1]
    before = texts(docs.collect())
    kept = plain_kept([(d, t or "") for d, t in before.items()])
    assert texts(rows) == {d: t for d, t in before.items() if d in kept}
    assert len(rows) < len(before)


def test_decontamination_stage(spark, steps):
    docs, _, rows = steps[2]
    before = texts(docs.collect())
    items = [(r["item_id"], r["text"]) for r in read_table(spark, SF, "benchmark").collect()]
    short = [(d, t) for d, t in before.items() if len(t) < 900]
    hit = {p[0] for p in plain_pairs(short, items)}
    assert {d for d, _ in short} - hit == {d for d in texts(rows) if d in dict(short)}
    assert texts(rows).items() <= before.items()


def test_secret_stage(steps):
    docs, _, rows = steps[3]
    before, after = texts(docs.collect()), texts(rows)
    assert before.keys() == after.keys()
    for d, text in before.items():
        assert not [s for s in plain_secrets(after[d]) if "<secret>" not in after[d][s[0]:s[1]]]
        if not plain_secrets(text) and text != after[d]:
            assert "<secret>" in after[d]
    untouched = sum(before[d] == after[d] for d in before)
    assert untouched > 0.8 * len(before)


def test_packing_stage(steps):
    docs, _, rows = steps[4]
    tokenizer = Tokenizer.from_file(vocabulary()[0])
    hold(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer)


def test_run_gives_what_the_stages_give(spark, steps):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = corpus_pipeline.run(spark, SF).select(*columns).collect()
    assert sorted(map(tuple, whole)) == sorted(tuple(r[c] for c in columns) for r in steps[-1][2])


def test_awkward_and_empty_documents(spark):
    for table in (with_clashes(awkward(spark)), awkward(spark).filter(F.lit(False))):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == table.columns
            docs.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


def test_stages_reject_only_what_they_name(spark):
    table = awkward(spark)
    kept = corpus_pipeline.known_language(spark, table, SF).collect()
    assert {r["doc_id"] for r in kept} == {None, 5, 6, 7, 8, 9}
    assert langid.UNKNOWN == "und" and secrets.KINDS == ("assign", "access", "hex")
