"""Removes lines that an earlier document already has, by levelled sorted runs.

A *run* is a Parquet table of line fingerprints, bucketed and sorted by fingerprint, that holds the keys of some batches seen
before.  A new batch is anti-joined against the runs bucket by bucket (the runs are never shuffled again), then its own new keys
become a run of level 0.  ``fanout`` runs of one level are merged into one run of the next, so a line is rewritten at most
log(batches) times and the number of runs stays small.

Main path: DataFrame functions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgrisk.llm.text import ascii_lower, only
from pkgrisk.session import Scratch

MIN_KEY_CHARS = 10
# Characters that a line key loses at both ends: space and 0x09 to 0x0D.
_BLANK = " \t\n\x0b\x0c\r"
# A key in more than one of so many rows is joined by broadcast; at most HOT_SHARE keys can be.
HOT_SHARE = 2000


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(_BLANK)))


def fingerprint(key: Column) -> Column:
    """The first 128 bits of SHA-256."""
    return F.unhex(F.substring(F.sha2(key, 256), 1, 32))


def text_lines(text: Column) -> Column:
    """Lines of a text; null is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The keys of all batches added so far, in levelled sorted runs."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 2):
        self._spark, self._fanout = spark, fanout
        # As many as the shuffles of this session have partitions, so that each bucket of a run is one file.
        self._buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._scratch = Scratch(spark, "line-runs")
        self._levels: list[list[str]] = []

    @property
    def runs(self) -> list[str]:
        """Names of the tables in use, largest level first."""
        return [name for level in reversed(self._levels) for name in level]

    def seen(self) -> DataFrame | None:
        """All keys in the runs; no key is in two runs."""
        tables = [self._spark.table(name) for name in self.runs]
        return None if not tables else _union(tables)

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Merge anti-join of distinct keys against each run."""
        for name in self.runs:
            keys = keys.join(self._spark.table(name), "key", "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Adds distinct keys that no run has, then compacts."""
        self._put(keys, 0)

    def _put(self, keys: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            keys.select("key").repartition(self._buckets, "key").write.format("parquet")
            .bucketBy(self._buckets, "key").sortBy("key").option("path", f"{self._scratch.path}/{name}").saveAsTable(name)
        )
        while len(self._levels) <= level:
            self._levels.append([])
        self._levels[level].append(name)
        if len(self._levels[level]) >= self._fanout:
            merged, self._levels[level] = self._levels[level], []
            self._put(_union([self._spark.table(n) for n in merged]), level + 1)
            for old in merged:
                self._spark.sql(f"DROP TABLE {old}")

    def close(self) -> None:
        """Forgets the tables; files stay in the scratch folder until its owner clears it."""
        for name in self.runs:
            self._spark.sql(f"DROP TABLE {name}")
        self._levels = []


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def repeated_lines(docs: DataFrame, batches: int = 4, min_chars: int = MIN_KEY_CHARS, buckets: int | None = None) -> DataFrame:
    """``doc_id, text_id, positions``: the lines (from 0) that a document with a smaller id already holds.

    Documents are taken in ascending order in ``batches`` ranges.  Keys of at least ``min_chars`` code points count.  A key that
    only one document holds, however often, is never listed.  Rows of equal ``doc_id`` are one document (their lines count
    together) with a row of their own for each different text; rows with a null ``doc_id`` come before all others and are one
    document too.  Documents without such lines have no row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    docs = only(docs, "doc_id", "text")
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000).alias("cuts")).head()["cuts"] or []
    cuts = sorted(set(cuts))
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + F.coalesce((F.col("doc_id") > cut).cast("int"), F.lit(0))
    lines = (
        docs.select("doc_id", F.xxhash64("text").alias("text_id"), batch.alias("batch"), F.posexplode(text_lines(F.col("text"))).alias("position", "line"))
        .select("doc_id", "text_id", "batch", "position", line_key(F.col("line")).alias("text_key"))
        .filter(F.length("text_key") >= min_chars)
        .select("doc_id", "text_id", "batch", "position", fingerprint(F.col("text_key")).alias("key"))
    )
    target = f"{scratch.path}/lines"
    lines.write.partitionBy("batch").parquet(target)
    saved = spark.read.schema("doc_id long, text_id long, position int, key binary, batch int").parquet(target)
    runs = LineRuns(spark, buckets=buckets)
    dropped = []
    for n in range(len(cuts) + 1):
        rows = saved.filter(F.col("batch") == n).drop("batch")
        # One row per key: its first document, and whether another one of this batch holds it as well.
        keys = rows.groupBy("key").agg(
            F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first"),
            F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("last"),
            F.count(F.lit(1)).alias("n"),
        )
        keys = scratch.save(keys, f"keys-{n}")
        fresh = scratch.save(runs.unseen(keys.select("key")), f"fresh-{n}")
        old = keys.join(fresh, "key", "left_anti").withColumn("seen", F.lit(True))
        inside = keys.filter("first.doc_id is distinct from last.doc_id").join(fresh, "key", "left_semi").withColumn("seen", F.lit(False))
        known = scratch.save(old.unionByName(inside).drop("last"), f"known-{n}")
        dropped.append(_matches(rows, known))
        if n < len(cuts):
            runs.add(fresh)
    runs.close()
    return _union(dropped).groupBy("doc_id", "text_id").agg(F.collect_set("position").alias("positions"))


def _matches(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose key is known from an earlier document.

    Keys with more than 1 / HOT_SHARE of the rows go by a broadcast of at most HOT_SHARE rows, so that no task gets the rows of
    a hot key; the rest is an ordinary join.
    """
    total = known.agg(F.sum("n")).head()[0] or 0
    hot = F.col("n") > max(1000, total // HOT_SHARE)
    parts = [
        rows.join(F.broadcast(known.filter(hot)), "key"),
        rows.join(known.filter(~hot), "key"),
    ]
    return _union(parts).filter(F.col("seen") | ~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).select("doc_id", "text_id", "position")


def dedup_lines(docs: DataFrame, batches: int = 4, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """All columns of ``docs`` and ``kept_text, n_lines, n_dropped``, which replace columns of these names.

    ``kept_text`` joins by newline the lines that no document with a smaller ``doc_id`` holds; short keys always stay.  A null or
    empty text is one empty line, which stays.  Every input row gives one row; an empty table gives none.
    """
    names = [n for n in docs.columns if n not in ("kept_text", "n_lines", "n_dropped")]
    dropped = repeated_lines(docs, batches, min_chars).toDF("__doc", "__text", "__drop")
    joined = docs.join(dropped, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__text")), "left")
    lines = text_lines(F.col("text"))
    # array_except hashes, so long documents take linear time; it keeps the order of the positions.
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    kept_text = F.when(F.col("__drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col("__lines"), i)), "\n")
    )
    return (
        joined.withColumn("__lines", lines)
        .select(
            *[F.col(f"`{n}`") for n in names],
            kept_text.alias("kept_text"),
            F.size("__lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"),
        )
    )
