"""Rows that every operator must take: nulls, empty and very long texts, repeated rows, ties, extra columns with clashing names."""

from __future__ import annotations

LONG = " ".join(f"w{i % 700} and" for i in range(30_000))
PLAIN = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix potions.\nA second line stands here.\nThird."
TEXTS = [
    (0, PLAIN), (1, PLAIN), (1, PLAIN), (2, None), (3, ""), (4, "   \n\n \t"), (5, LONG), (6, LONG + " more"), (7, PLAIN.replace("fox", "cat")),
    (8, "\U0001f600 été 一二三 ①②"), (8, "same id, other text"), (None, "a row without an id"), (None, None), (9, "x" * 3000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, class string, n long, words string, label string, row string, ids string"


def documents(spark):
    return spark.createDataFrame([(i, t, None, "s", None, "k", 1, "c", 2, "w", "l", "r", "i") for i, t in TEXTS], SCHEMA)


def empty(spark):
    return documents(spark).limit(0)
