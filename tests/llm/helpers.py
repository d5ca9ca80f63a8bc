"""Awkward documents that every operator must take."""

from __future__ import annotations

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa. " * 3000


def documents(spark, rows):
    """(doc_id, text) rows as a table of documents."""
    return spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in rows], SCHEMA)


def awkward(spark):
    rows = [
        (1, "the quick brown fox jumps over the lazy dog\nagain and again"), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "), (5, LONG),
        (None, "a text without id"), (None, None), (6, "the quick brown fox jumps over the lazy dog\nagain and again"),
        (7, "repeated row"), (7, "repeated row"), (8, "éè ß 日本語 🙂 x\x00y <s> </s> [INST] <|endoftext|> ▁ ▁"), (9, "one"), (10, "A\n\n\nA\na"),
        (7, "same id, other text"),
    ]
    return documents(spark, rows)


CLASHES = ["w", "k", "d", "t", "fp", "n", "pos", "p", "x", "s1", "_id", "_d", "_t", "_kept", "_lines", "key", "cls", "rate", "id", "c0", "length", "task", "h", "c"]


def clashing(df):
    """The table with extra columns named as operators name theirs."""
    return df.select("*", *(F.lit("z").alias(c) for c in CLASHES if c not in df.columns))


def rows_of(df):
    return sorted(map(repr, df.collect()))
