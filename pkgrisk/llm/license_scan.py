"""Finds license phrases and notices in texts by diagonal voting.

Every pair of neighbouring words of a text is joined to the places where a template has the pair.  A match at word i of the text and
word j of the template votes for the diagonal i - j; an unbroken copy puts all its votes on one diagonal.  Diagonals with enough votes
that lie beside each other (words put in or left out) are merged into one span.  A span is verified by the places of the template that
its words stand for: each place counts once, however many diagonals vote for it, and the span counts if enough places are covered.
Diagonals are merged over at most NEAR words, less than the words of the shortest fragment, so fragments beside each other keep the order
that the template has.
A base phrase counts only where all its words stand consecutively: all its votes on one diagonal.

DataFrame functions only.  The templates are fixed text, so their pairs are broadcast whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pkgrisk.llm.text import only, word_array
from pkgrisk.session import Scratch

# Phrases and their labels.
PHRASES = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)
# Passages of public license notices and their labels.
NOTICES = (
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by", "licensed under a creative commons attribution 4.0 international license"),
    (
        "mit-grant",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
        "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
        "merge publish distribute sublicense and or sell copies of the software",
    ),
    (
        "apache-notice",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at",
    ),
    (
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    ("gpl-line", "this work is licensed under the gnu general public license version 3"),
    ("mit-line", "released under the mit license"),
    (
        "bsd-terms",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met",
    ),
)
MIN_VOTES = 3
NEAR = 4
COVERAGE = 0.7


def template_pairs(spark: SparkSession) -> DataFrame:
    """``w1, w2, at, template, label, pairs, base``: each word pair of each template and its place."""
    rows = [(label, text, True) for label, text in PHRASES] + [(label, text, False) for label, text in NOTICES]
    listed = F.array(*[F.struct(F.lit(n).alias("template"), F.lit(a).alias("label"), F.lit(b).alias("text"), F.lit(c).alias("base")) for n, (a, b, c) in enumerate(rows, 1)])
    words = spark.range(1).select(F.inline(listed)).withColumn("words", word_array(F.col("text")))
    return words.select(
        "template", "label", "base", "words", (F.size("words") - 1).alias("pairs"),
        F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("at"),
    ).select("template", "label", "base", "pairs", "at", F.get("words", F.col("at") - 1).alias("w1"), F.get("words", "at").alias("w2"))


def _hash(w1: Column, w2: Column) -> Column:
    return F.xxhash64(w1, w2)


def diagonals(docs: DataFrame) -> DataFrame:
    """``row, doc_id, n_words, template, label, base, pairs, diagonal, votes, places, first, last``: votes by text and diagonal.

    ``places`` has a bit for each pair of the template (63 at most) that votes.
    Every row of ``docs`` has one line with template 0, which carries its id and number of words.
    """
    words = only(docs, "doc_id", "text").select("doc_id", F.monotonically_increasing_id().alias("row"), word_array(F.col("text")).alias("words"))
    # Pair i is the words i - 1 and i; place 0 is the text itself.
    pairs = words.select("row", "doc_id", "words", F.size("words").alias("n_words"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)))).alias("i"))
    w1, w2 = F.get("words", F.col("i") - 1), F.get("words", "i")
    pairs = pairs.select("row", "doc_id", "n_words", "i", w1.alias("t1"), w2.alias("t2"), F.when(F.col("i") == 0, F.lit(0)).otherwise(_hash(w1, w2)).alias("pair"))
    known = template_pairs(docs.sparkSession).withColumn("pair", _hash(F.col("w1"), F.col("w2")))
    none = known.limit(1).select(
        F.lit(0).alias("template"), F.lit("").alias("label"), F.lit(False).alias("base"), F.lit(0).alias("pairs"), F.lit(0).alias("at"),
        F.lit(None).cast("string").alias("w1"), F.lit(None).cast("string").alias("w2"), F.lit(0).cast("long").alias("pair"),
    )
    found = pairs.join(F.broadcast(known.unionByName(none)), "pair").filter(
        ((F.col("i") == 0) & (F.col("template") == 0)) | ((F.col("i") > 0) & (F.col("t1") == F.col("w1")) & (F.col("t2") == F.col("w2")))
    )
    return found.groupBy("row", "template", (F.col("i") - F.col("at")).alias("diagonal")).agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("label").alias("label"), F.first("base").alias("base"),
        F.first("pairs").alias("pairs"), F.count(F.lit(1)).alias("votes"),
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at"))).alias("places"), F.min("i").alias("first"), F.max("i").alias("last"),
    )


def license_spans(docs: DataFrame) -> DataFrame:
    """``row, doc_id, n_words, label, base, start, end, coverage``: word spans, and one line without a label for every input row.

    Words count from 0, ``end`` is exclusive.  Spans below COVERAGE are listed too; base phrases are listed only in full.  Null and
    empty texts have no words; repeated rows are rows of their own; an empty table has no lines; columns other than ``doc_id`` and
    ``text`` are not read.  Votes are written once: rows are numbered once, and texts are split into words once.
    """
    votes = Scratch(docs.sparkSession, "license-scan").save(diagonals(docs), "votes")
    own = votes.filter("template = 0").select(
        "row", "doc_id", "n_words", F.lit(None).cast("string").alias("label"), F.lit(False).alias("base"),
        F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(0.0).alias("coverage"),
    )
    phrases = votes.filter((F.col("template") > 0) & F.col("base") & (F.col("votes") == F.col("pairs"))).select(
        "row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("n_words"), "label", "base",
        F.col("diagonal").alias("start"), (F.col("last") + 1).alias("end"), F.lit(1.0).alias("coverage"),
    )
    notices = votes.filter((F.col("template") > 0) & ~F.col("base") & (F.col("votes") >= MIN_VOTES))
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal")
    opens = (F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > NEAR).cast("int")
    notices = notices.withColumn("opens", F.coalesce(opens, F.lit(1))).withColumn("group", F.sum("opens").over(by_diagonal))
    notices = notices.groupBy("row", "template", "group").agg(
        F.first("label").alias("label"), F.first("pairs").alias("pairs"), F.bit_count(F.bit_or("places")).alias("covered"), F.min("first").alias("first"), F.max("last").alias("last"),
    ).select(
        "row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("n_words"), "label", F.lit(False).alias("base"),
        (F.col("first") - 1).alias("start"), (F.col("last") + 1).alias("end"), (F.col("covered") / F.col("pairs")).alias("coverage"),
    )
    return own.unionByName(phrases).unionByName(notices)


def license_report(spans: DataFrame) -> DataFrame:
    """Digest columns, one row per input row: the best coverage is the score; a notice's label counts from COVERAGE on."""
    base, named = F.col("base"), F.col("label").isNotNull() & (F.col("coverage") >= COVERAGE)

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(labels), ",")

    return spans.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"), F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"), joined(F.collect_set(F.when(named, F.col("label")))).alias("labels"),
        F.max("coverage").alias("score"),
    ).drop("row")
