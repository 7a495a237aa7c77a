"""Small tables with awkward rows, for all operators."""

from __future__ import annotations

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
# Names that results and intermediate columns of the operators have.
CLASHING = ("score", "row", "fp", "hits", "base", "spans", "slot", "bin", "target", "stats", "features", "component_id",
            "lang_pred", "learned", "occurrences", "held", "rate", "length")

SF = "/root/testdata/sf0.001"


def documents(spark, rows):
    """Rows of (doc_id, text) or whole rows, as documents."""
    full = [r if len(r) == 5 else (r[0], r[1], "en", "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def awkward(spark):
    """NULLs in every column, empty, letterless, very long, repeated and tied rows."""
    long_text = "alpha beta gamma delta epsilon " * 20_000
    return documents(spark, [
        (None, "no id here", "en", None, None), (1, None, None, None, None), (2, "", "en", "s", 0),
        (3, "   \n\t ", None, "s", 6), (4, "1234 !!", "de", "s", 7), (5, long_text, "en", "s", len(long_text)),
        (6, "a" * 200_000, None, "s", 200_000), (7, "same words in two rows", "en", "s", 22),
        (7, "same words in two rows", "en", "s", 22), (8, "same words in two rows", "en", "s", 22),
        (9, "über naïve façade 日本語 🎉", "fr", "s", 23), (None, None, None, None, None),
    ])


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(name) for name in CLASHING])
