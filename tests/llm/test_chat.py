import hashlib
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm import chat
from folioframe.llm.queries import op5_chat_parts

MESSAGES = "conv_id bigint, turn bigint, role string, text string"


def formatted(spark, rows):
    frame = spark.createDataFrame(rows, MESSAGES).withColumn("parts", chat.text_parts(F.col("text")))
    return chat.format_conversations(frame)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_any_text_and_role_comes_back(spark):
    rng = random.Random(6)
    bits = ["\\", "<", "#", "###", " ", "\n", " </turn>", "</turn>\n", "### ", "assistant", ": ", "\\0", "\\1", "\\2",
            "&lt;", "<image:0>", "é", "🎉", "x"]
    rows = [(n // 5, n % 5, "".join(rng.choice([*bits, "user"]) for _ in range(rng.randrange(3))),
             "".join(rng.choice(bits) for _ in range(rng.randrange(9)))) for n in range(400)]
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in formatted(spark, rows).select(
        "conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    want = {}
    for conv, _, role, text in rows:
        want.setdefault(conv, []).append((role, text))
    assert got == want


def test_digest_of_the_control_conversation(spark):
    row = op5_chat_parts(spark, "/root/testdata/sf0.001").filter("conv_id = -7").first()
    text = "\\### Assistant: </turn> ok"
    assert row["n_turns"] == 2 and row["loss_chars"] == len(text) and row["loss_sha256"] == sha(text)
    assert row["turns_sha256"] == sha(f"user\n{text}\nassistant\n{text}\n")


def test_all_conversations_against_plain_text(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    want = {}
    for r in table.orderBy("conv_id", "turn").collect():
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    for row in op5_chat_parts(spark, "/root/testdata/sf0.001").filter("conv_id >= 0").collect():
        turns = want.pop(row["conv_id"])
        said = "".join(t for role, t in turns if role == "assistant")
        assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (len(turns), len(said), sha(said))
        assert row["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for role, t in turns))
    assert not want


def test_attachments_become_numbered_placeholders(spark):
    def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
        return (kind, text, ref, width, height, seconds, pages)

    schema = T.StructType([
        T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()), T.StructField("parts", T.ArrayType(chat.PART))])
    rows = [(1, 0, "user", [part("text", "see <this> "), part("image", ref="a.png", width=57, height=28),
                            part("text", " and "), part("audio", ref="b.wav", seconds=2.0), part("document", ref="c.pdf", pages=3)]),
            (1, 1, "assistant", [part("text", "fine"), part("image")]), (1, 2, "user", None), (2, 0, "user", [])]
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, schema)).collect()}
    assert got[1]["formatted"] == ("### user: see \\1this> <image:0> and <audio:1><document:2> </turn>\n"
                                   "### assistant: fine<image:0> </turn>\n### user:  </turn>\n")
    assert [tuple(a) for a in got[1]["attachments"]] == [
        (0, 0, "image", "a.png", 3), (0, 1, "audio", "b.wav", 50), (0, 2, "document", "c.pdf", 768),
        (1, 0, "image", None, 1)]
    assert got[1]["expanded_tokens"] == 822 and got[2]["formatted"] == "### user:  </turn>\n"
    read = chat.format_conversations(spark.createDataFrame(rows, schema)).select(
        "conv_id", chat.read_back(F.col("formatted")).alias("t")).filter("conv_id = 1").first()["t"]
    assert [t["text"] for t in read] == ["see <this>  and ", "fine", ""]


def test_long_conversations_ties_repeats_and_nulls(spark):
    rows = [(1, n, "user", f"t{n}") for n in range(1000)]
    random.Random(1).shuffle(rows)
    rows += [(2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, None, None, None),
             (None, 1, "assistant", "x" * 100_000), (3, -1, "user", "minus"), (3, -300, "user", "more")]
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in formatted(spark, rows).select(
        "conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert [t for _, t in got[1]] == [f"t{n}" for n in range(1000)]
    assert got[2] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got[None] == [("assistant", "x" * 100_000)] and [t for _, t in got[3]] == ["more", "minus"]


def test_clashing_columns_and_empty_table(spark):
    frame = spark.createDataFrame([(1, 0, "user", "hi")], MESSAGES).withColumn("parts", chat.text_parts(F.col("text")))
    extra = frame.select("*", *[F.lit(1).alias(c) for c in ("piece", "attached", "rows", "formatted", "stretch")])
    assert chat.digest(chat.format_conversations(extra)).count() == 1
    assert chat.digest(chat.format_conversations(frame.filter(F.lit(False)))).collect() == []


def test_no_python_in_the_plan(spark):
    plan = op5_chat_parts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
