"""Finds passages of benchmark items in documents by Wu-Manber multi-pattern search over words.

The windows of one length are one search.  Its shift table maps a block of words to how far the search may jump when it reads that
block: m - block + 1 words where no window holds it.  Only where the shift is zero does it look at the bucket of windows that end
in the block, and compares them word by word.

The windows are dealt into blocks of at most WINDOWS_PER_BLOCK rows on average; each block is broadcast and searched for in all
documents, so a large benchmark costs more passes, not more memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from operator import eq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgrisk.llm.text import only, utf8, word_array, words_of
from pkgrisk.session import Scratch

WINDOW = 10
BLOCK_WORDS = 2
WINDOWS_PER_BLOCK = 200_000
_SEEN = "row_id long, digest binary, n_words long, spans array<struct<start: long, end: long>>, items array<string>"


class WuManber:
    """Search for windows of ``length`` words; ``windows`` maps a window to what is reported for it."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], list[str]]):
        self.length, self._windows = length, windows
        self._block = size = min(BLOCK_WORDS, length)
        self._far = length - size + 1
        self._shift: dict[tuple[bytes, ...], int] = {}
        # Windows by their last block and then by their first word.
        self._buckets: dict[tuple[bytes, ...], dict[bytes, list[tuple[bytes, ...]]]] = {}
        for window in windows:
            for end in range(size, length + 1):
                block = window[end - size : end]
                self._shift[block] = min(self._shift.get(block, self._far), length - end)
            self._buckets.setdefault(window[-size:], {}).setdefault(window[0], []).append(window)

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """Start and report of each place where a window occurs."""
        length, size, far, shift = self.length, self._block, self._far, self._shift
        i, n = length, len(words)
        while i <= n:
            block = tuple(words[i - size : i])
            jump = shift.get(block, far)
            if jump:
                i += jump
                continue
            start = i - length
            for window in self._buckets[block].get(words[start], ()):
                if all(map(eq, window, words[start:i])):
                    yield start, self._windows[window]
            i += 1


def windows_of(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """``item, window``: the distinct windows of ``width`` consecutive words; a shorter item is one window, one without words none."""
    words = only(items, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), word_array(F.col("text")).alias("w")).filter(F.size("w") > 0)
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1))))
    return words.select("item", "w", start.alias("start")).select("item", F.slice("w", F.col("start"), width).alias("window")).distinct()


def searches(rows: list[tuple[str, list[str]]]) -> list[WuManber]:
    """One search for each window length."""
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item, window in rows:
        key = tuple(w.encode("utf-8", "surrogatepass") for w in window)
        by_length.setdefault(len(key), {}).setdefault(key, []).append(item)
    return [WuManber(n, windows) for n, windows in sorted(by_length.items())]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as a union of disjoint ones, in order."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _search(rows: list[tuple[str, list[str]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = searches(rows)
        for batch in batches:
            out = []
            for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                words = words_of(text)
                spans, items = [], set()
                for search in own:
                    for start, found in search.occurrences(words):
                        if spans and start <= spans[-1][1] and start >= spans[-1][0]:
                            spans[-1] = (spans[-1][0], max(spans[-1][1], start + search.length))
                        else:
                            spans.append((start, start + search.length))
                        items.update(found)
                out.append({
                    "row_id": row_id, "digest": sha256(utf8(text)).digest(), "n_words": len(words), "items": sorted(items),
                    "spans": [{"start": a, "end": b} for a, b in merged(spans)],
                })
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return run


_ARROW = pa.schema([
    ("row_id", pa.int64()), ("digest", pa.binary()), ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())),
])


def covered(spans: Column) -> Column:
    """Number of words in the union of spans, which may overlap and come in any order."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(state: Column, span: Column) -> Column:
        new = F.greatest(F.lit(0), span["end"] - F.greatest(span["start"], state["end"]))
        return F.struct(F.greatest(state["end"], span["end"]).alias("end"), (state["n"] + new).alias("n"))

    return F.aggregate(F.array_sort(spans), zero, step)["n"]


def benchmark_hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", width: int = WINDOW) -> DataFrame:
    """``key, n_words, spans, items``: one row per row of ``docs`` with the word spans that lie in occurrences of windows.

    Null and empty texts have no words and no hits; items without words are never found; an empty benchmark hits nothing.  Equal
    items are found together; a null ``item_id`` is ''.  Rows of equal key stay rows of their own, whatever the number of blocks:
    what the blocks find is brought together by key and text, and rows equal in both come back as often as they are there.
    """
    spark = docs.sparkSession
    windows = windows_of(items, width)
    count = windows.count()
    blocks = max(1, -(-count // WINDOWS_PER_BLOCK))
    docs = docs.select(F.col(key).cast("long").alias("row_id"), "text")
    windows = windows.withColumn("block", F.pmod(F.xxhash64("item", "window"), F.lit(blocks)))
    if blocks > 1:
        windows = Scratch(spark, "benchmark").save(windows, "windows")
    found = None
    for n in range(blocks):
        rows = [(r["item"], r["window"]) for r in windows.filter(F.col("block") == n).toLocalIterator()]
        shared = spark.sparkContext.broadcast(rows)

        def run(batches, shared=shared):
            return _search(shared.value)(batches)

        part = docs.mapInArrow(run, _SEEN).withColumn("block", F.lit(n))
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        found = found.groupBy("row_id", "digest").agg(
            F.max("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.count_if(F.col("block") == 0).alias("copies"),
        ).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return found.select(F.col("row_id").alias(key), "n_words", "spans", "items")


def hit_report(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digest columns of :func:`benchmark_hits`."""
    return hits.select(
        key, "n_words", covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
