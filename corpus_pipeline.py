"""From raw documents to token ids, as stages of the text operators.

Every stage takes what its predecessor kept, written as Parquet and read again, and works on all of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgrisk.llm import decontaminate, jaccard_join, line_dedup, piece_lattice, quality
from pkgrisk.llm.queries import QUALITY_CUT, table
from pkgrisk.llm.vocabulary import model_path
from pkgrisk.session import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted to the labelled ones among them."""
    rows = quality.train_rows(docs, table(spark, sf_dir, "labels"), "quality", F.expr("crc32(cast(doc_id as string)) % 5 <> 0"))
    return _documents(quality.with_quality(docs, quality.fit(rows), name="__score").filter(F.col("__score") >= QUALITY_CUT))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a smaller ``doc_id`` holds; a text of which nothing is left goes."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    kept = kept.filter("n_dropped = 0 or length(kept_text) > 0")
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: that of the smallest ``doc_id``; texts without words all stay."""
    docs = docs.select(*COLUMNS)
    classes = jaccard_join.similar_documents(docs)
    first = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id").distinct().select(F.col("doc_id").alias("__id"))
    kept = docs.join(first, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    # Rows of one id are one document; of equal rows one stays.
    return _documents(kept.dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    hits = decontaminate.benchmark_hits(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    bad = hits.filter(F.size("spans") > 0).select(F.col("doc_id").alias("__id")).distinct()
    return _documents(docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents and the piece ids of the text."""
    encoded = piece_lattice.encode(docs.select(*COLUMNS), model_path())
    return encoded.select(*COLUMNS, "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode_pieces),
]

# SQL has no way to fit the classifier; the tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "corpus-pipeline")
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{n}")
    return docs
