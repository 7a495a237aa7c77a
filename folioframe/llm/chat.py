"""Chat formatting of typed content parts, made of column expressions only.

A message's parts are visited in order: a text part gives its escaped text, an attachment (image, audio, document) a
numbered placeholder, its reference and the tokens it will expand to. Turns read `### role: content </turn>` and a line
break. Backslash, `<` and `#` of texts are escaped by a backslash and a digit, so no text can hold a mark of the
template, and the escape is undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPENING, AFTER_ROLE, CLOSING = "### ", ": ", " </turn>\n"
ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("#", "\\2"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\3"), ("\n", "\\4"))
PLACEHOLDER = "<[a-z]+:[0-9]+>"
LOSS_ROLE = "assistant"
# Turns of so many neighbouring numbers are joined by one task before a conversation's stretches are.
STRETCH = 256
PART = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("ref", T.StringType()), T.StructField("width", T.LongType()),
    T.StructField("height", T.LongType()), T.StructField("seconds", T.DoubleType()),
    T.StructField("pages", T.LongType()),
])
# An image costs a token per 28 x 28 patch, audio 25 a second, a document page 256; at least one each.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256


def _replace(column: Column, pairs) -> Column:
    for old, new in pairs:
        column = F.replace(column, F.lit(old), F.lit(new))
    return column


def escape(column: Column, pairs=ESCAPES) -> Column:
    return _replace(column, pairs)


def unescape(column: Column, pairs=ESCAPES) -> Column:
    return _replace(column, [(new, old) for old, new in reversed(pairs)])


def text_parts(text: Column) -> Column:
    """One text part; a NULL text is an empty one."""
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in PART.fields[2:]]
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *nothing))


def expanded_tokens(part: Column) -> Column:
    """Tokens an attachment expands to; unknown measures count as the least."""
    def patches(side: str) -> Column:
        return F.ceil(F.coalesce(part[side], F.lit(1)) / PATCH)

    tokens = F.when(part["type"] == "image", patches("width") * patches("height")).when(
        part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE)).when(
        part["type"] == "document", F.coalesce(part["pages"], F.lit(1)) * PAGE_TOKENS)
    return F.greatest(F.lit(1), F.coalesce(tokens, F.lit(1))).cast("bigint")


def is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def content(parts: Column) -> Column:
    """Texts and placeholders in order; attachments are numbered from 0 within the message."""
    def visit(part: Column, at: Column) -> Column:
        number = F.size(F.filter(F.slice(parts, F.lit(1), at), lambda p: ~is_text(p)))
        return F.when(is_text(part), escape(F.coalesce(part["text"], F.lit("")))).otherwise(
            F.concat(F.lit("<"), F.regexp_replace(F.lower(part["type"]), "[^a-z]", ""), F.lit(":"), number, F.lit(">")))

    return F.array_join(F.transform(parts, visit), "")


def attachments(parts: Column) -> Column:
    """number, type, ref and tokens of the attachments, in order."""
    return F.transform(F.filter(parts, lambda p: ~is_text(p)), lambda p, at: F.struct(
        at.alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))


def format_turns(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, parts -> the same beside `piece` (the formatted turn) and `attached`."""
    role = escape(F.coalesce("role", F.lit("")), ROLE_ESCAPES)
    return messages.select("conv_id", "turn", "role", "parts").withColumn("piece", F.concat(
        F.lit(OPENING), role, F.lit(AFTER_ROLE), content(F.coalesce("parts", F.array().cast(T.ArrayType(PART)))),
        F.lit(CLOSING))).withColumn("attached", F.coalesce(attachments(F.col("parts")), F.array()))


def format_conversations(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, attachments (with their turn) and expanded_tokens of every conversation.

    Rows are (conv_id, turn, role, parts); turns go by number, NULL first, equal numbers by their formatted text, and
    repeated rows are repeated turns. A NULL role or text reads as empty, NULL parts as none; NULL conv_ids form one
    conversation. Turns are formatted before any shuffle and joined in stretches of STRETCH numbers, so a
    conversation of any length is put together from few rows. Other columns are left out.
    """
    turns = format_turns(messages)
    stretches = turns.groupBy("conv_id", F.floor(F.col("turn") / STRETCH).alias("stretch")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "piece", "attached"))).alias("rows")).select(
        "conv_id", "stretch", F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("piece"),
        F.flatten(F.transform("rows", lambda r: F.transform(r["attached"], lambda a: F.struct(
            r["turn"].alias("turn"), a["number"].alias("number"), a["type"].alias("type"), a["ref"].alias("ref"),
            a["tokens"].alias("tokens"))))).alias("attached"))
    return stretches.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("stretch", "piece", "attached"))).alias("rows")).select(
        "conv_id", F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
        F.flatten(F.transform("rows", lambda r: r["attached"])).alias("attachments")).withColumn(
        "expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda total, a: total + a["tokens"]))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of role and text, placeholders left out of the text."""
    pieces = F.split(formatted, CLOSING)

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(OPENING) + 1))
        at = F.instr(body, AFTER_ROLE)
        text = F.substr(body, at + len(AFTER_ROLE))
        return F.struct(
            unescape(F.substr(body, F.lit(1), at - 1), ROLE_ESCAPES).alias("role"),
            unescape(F.regexp_replace(text, PLACEHOLDER, "")).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from `formatted`."""
    turns = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform(
        F.filter("turns", lambda t: t["role"] == LOSS_ROLE), lambda t: t["text"]), "")
    everything = F.array_join(F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(everything, 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"), F.sha2(said, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
