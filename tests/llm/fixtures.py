"""Texts and tables that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import os

LONG = "lorem ipsum dolor sit amet " * 6000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, "the QUICK brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (3, None, None, None),
    (4, "", "en", ""),
    (5, " \t\n ", "de", "b"),
    (6, "one two", "en", "b"),
    (6, "one two", "en", "b"),
    (7, LONG, "en", "a"),
    (8, "api_key = 'abcDEF123456' AKIA" + "Q7" * 9 + " deadbeefdeadbeefdeadbeef mail a@b.org", "en", "c"),
    (9, "é ß 😀 naïve café 日本語 \x0b end", "fr", "c"),
    (None, "no id at all but some words here", "en", None),
    (10, "ab1" * 40_000, "en", "a"),
    (-5, "negative id \x1f unit separator is no space", "de", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that the operators use inside.
CLASHING = ("n", "cls", "key", "a", "b", "m", "base", "more", "row", "bin", "place", "size", "stop", "start", "shard", "score", "kept", "u", "digits", "spans", "text_", "grp", "mark", "gone_id", "gone_mark", "twice_id", "twice_mark", "m_id", "print", "m_print", "full", "parts", "uid", "total")


def documents(spark, rows=None, clashing=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(TEXTS if rows is None else rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *(F.lit(0).alias(c) for c in CLASHING)) if clashing else df


def write_tables(spark, folder, rows=None, labels=((1, 1, 0), (8, 0, 1), (6, 1, 0), (None, 0, 0), (2, None, None))):
    documents(spark, rows).write.parquet(os.path.join(folder, "documents.parquet"))
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(os.path.join(folder, "labels.parquet"))
    return folder
