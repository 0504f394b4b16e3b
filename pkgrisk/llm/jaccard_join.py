"""Similarity join on word n-grams: MinHash candidates, Bayesian pruning, exact verification.

Texts with the same set of n-grams are one *class*; a class is compared once, however many copies it has.

1. Each class has a signature of MinHash values.  Classes that agree on all values of a band share a bucket.
2. Inside buckets, pairs are compared a few values at a time.  With m of n values equal, the posterior of the similarity J under a
   uniform prior is Beta(m + 1, n - m + 1); a pair goes as soon as P(J >= threshold) falls below the tolerance.  What is left joins
   classes into groups of possible neighbours.  No pair is written: a task returns one edge for each class that it attached.
3. Inside these groups the surviving pairs are verified on the whole n-gram sets.  A task returns numbers of links and a spanning
   forest, so the output is linear in the classes even where all of them are near copies of each other.

Large buckets and groups are cut into blocks, and each pair of blocks is a row group of its own that any task can take.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from pkgrisk.llm.components import components
from pkgrisk.llm.text import only, words_of
from pkgrisk.session import Scratch

WORDS = 5
THRESHOLD = 0.8
TOLERANCE = 1e-4
BANDS = 32
ROWS = 5
HASHES = BANDS * ROWS
CHUNK = 16
BLOCK = 512


def ngrams(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text; a shorter text is one n-gram, a text without words has none."""
    found = words_of(text)
    if not found:
        return np.zeros(0, np.uint64)
    width = min(words, len(found))
    own = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    out = np.zeros(len(found) - width + 1, np.uint64)
    for k in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + own[k : len(found) - width + 1 + k])
    return np.unique(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_random = np.random.default_rng(20)
_FACTORS = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signature(grams: np.ndarray) -> np.ndarray:
    """MinHash values, 16 bits of each; n-grams go in pieces, so long texts need no more memory than short ones."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 256):
        part = grams[at : at + 256]
        np.minimum(low, (part[None, :] * _FACTORS[:, None] + _SHIFTS[:, None]).min(1), out=low)
    # A minimum's high bits are small numbers; its low bits are mixed by its own multiplier.
    return (_mix(low) >> np.uint64(48)).astype(np.uint16)


def least_matches(threshold: float, tolerance: float, size: int = HASHES, chunk: int = CHUNK) -> list[tuple[int, int]]:
    """For n = chunk, 2 chunk, ...: the fewest of n equal values with which a pair stays."""

    def posterior(m: int, n: int) -> float:
        # P(J >= t) for Beta(m + 1, n - m + 1) is P(Binomial(n + 1, t) <= m).
        return sum(math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1))

    return [(n, next(m for m in range(n + 1) if posterior(m, n) >= tolerance)) for n in range(chunk, size + 1, chunk)]


def survivors(signatures: np.ndarray, i: int, others: np.ndarray, table: list[tuple[int, int]]) -> np.ndarray:
    """Which of the pairs of member i and the others stay to the end."""
    alive, matches, at = np.arange(len(others)), np.zeros(len(others), np.int32), 0
    for n, least in table:
        matches = matches + (signatures[others[alive], at:n] == signatures[i, at:n]).sum(1, dtype=np.int32)
        keep = matches >= least
        alive, matches, at = alive[keep], matches[keep], n
        if not len(alive):
            break
    return alive


class _Forest:
    """Trees over the members of one cell; edges are those that joined two trees."""

    def __init__(self, n: int):
        self.tree = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def join(self, i: int, j: int) -> None:
        a, b = self.tree[i], self.tree[j]
        if a != b:
            self.tree[self.tree == max(a, b)] = min(a, b)
            self.edges.append((i, j))


def in_blocks(members: DataFrame, group: str, block: int = BLOCK) -> DataFrame:
    """``members`` with ``cell`` and ``side``: all pairs of a group of up to ``block`` members meet in one cell; a larger group
    is cut into blocks, and each pair of its blocks is a cell."""
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    joined = members.join(sizes, group).withColumn("blocks", blocks)
    joined = joined.withColumn("own", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")).otherwise(0))
    joined = joined.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return joined.withColumn("cell", cell).withColumn("side", side).drop("n", "blocks", "own", "other")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Row groups of equal cell; rows come sorted by cell."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        cells = batch.column("cell").to_numpy()
        cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)] if len(cells) else []
        for a, b in zip(cuts, cuts[1:]):
            if kept and cells[a] != last:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(a, b - a))
            last = cells[a]
    if kept:
        yield pa.Table.from_batches(kept)


def _sets(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of n-gram arrays, and the start of each row's."""
    sizes = np.concatenate([[0]] + [np.diff(c.offsets.to_numpy()) for c in column.chunks])
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks]).view(np.uint64), np.cumsum(sizes)


def _signatures(cell: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(cell.column("signature").to_pylist()), np.uint16).reshape(-1, HASHES)


def _candidates(side: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Pairs of a cell: one member and those it meets, all later ones or the other block."""
    if side[0]:
        right = np.flatnonzero(side == 2)
        for i in np.flatnonzero(side == 1):
            yield int(i), right
    else:
        for i in range(len(side) - 1):
            yield i, np.arange(i + 1, len(side))


def _attach(table: list[tuple[int, int]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            own = _signatures(cell)
            forest = _Forest(len(own))
            for i, others in _candidates(cell.column("side").to_numpy()):
                # A pair that is joined already needs no look: the next step compares all members of a group.
                others = others[forest.tree[others] != forest.tree[i]]
                for j in others[survivors(own, i, others, table)]:
                    forest.join(i, int(j))
            if forest.edges:
                yield _edges(cell.column("node").to_numpy(), forest)

    return run


def _edges(nodes: np.ndarray, forest: _Forest) -> pa.RecordBatch:
    ends = np.array(forest.edges)
    return pa.RecordBatch.from_pydict({"a": nodes[ends[:, 0]], "b": nodes[ends[:, 1]]})


def _verify(table: list[tuple[int, int]], threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            signatures, (grams, at) = _signatures(cell), _sets(cell.column("grams"))
            size = np.diff(at)
            forest, links = _Forest(len(size)), np.zeros(len(size), np.int64)
            for i, others in _candidates(cell.column("side").to_numpy()):
                # Sets of very different size can't be similar enough.
                others = others[np.minimum(size[i], size[others]) >= threshold * np.maximum(size[i], size[others])]
                others = others[survivors(signatures, i, others, table)]
                own = grams[at[i] : at[i + 1]]
                # In pieces, so that long texts need no more memory at once than their own sets.
                for piece in np.array_split(others, -(-len(others) * len(own) // 1_000_000) or 1):
                    if not len(piece):
                        continue
                    rest = np.concatenate([grams[at[j] : at[j + 1]] for j in piece])
                    place = np.minimum(np.searchsorted(own, rest), len(own) - 1)
                    starts = np.concatenate(([0], np.cumsum(size[piece])[:-1]))
                    shared = np.add.reduceat((own[place] == rest).astype(np.int64), starts)
                    close = piece[shared >= threshold * (size[i] + size[piece] - shared) - 1e-9]
                    links[i] += len(close)
                    links[close] += 1
                    for j in close[forest.tree[close] != forest.tree[i]]:
                        forest.join(i, int(j))
            nodes, linked = cell.column("node").to_numpy(), np.flatnonzero(links)
            ends = np.array(forest.edges, np.int64).reshape(-1, 2)
            if len(linked):
                yield pa.RecordBatch.from_pydict({
                    "a": np.concatenate((nodes[linked], nodes[ends[:, 0]])), "b": np.concatenate((nodes[linked], nodes[ends[:, 1]])),
                    "n": np.concatenate((links[linked], np.zeros(len(ends), np.int64))),
                })

    return run


def _class_of(grams: np.ndarray) -> bytes | None:
    return blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [ngrams(text.as_py()) for text in batch.column("text")]
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "class": pa.array([_class_of(s) for s in sets], pa.binary()),
            "signature": pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
        })


def _with_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of texts that are of the class asked for (ids need not be unique)."""
    for batch in batches:
        sets = [ngrams(text.as_py()) for text in batch.column("text")]
        same = pa.array([_class_of(s) == c for s, c in zip(sets, batch.column("class").to_pylist(), strict=True)])
        grams = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("root"), batch.column("signature"), grams], ["node", "root", "signature", "grams"]).filter(same)


def _buckets(members: DataFrame) -> DataFrame:
    width = 2 * ROWS
    bands = F.array(*[F.xxhash64(F.lit(n), F.substring("signature", n * width + 1, width)) for n in range(BANDS)])
    return members.select("node", F.explode(bands).alias("bucket"))


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """``doc_id, class_id, copy_of, n_links``: one row per row of ``docs``.

    ``copy_of`` is the smallest ``doc_id`` with the same set of n-grams; ``n_links`` counts the other sets of Jaccard similarity of
    at least ``threshold``; ``class_id`` is the smallest ``doc_id`` that a chain of links and copies reaches.  Texts without words
    (null, empty) are similar to nothing and their own class.  Null ids are kept and never the smallest unless all are null.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard-join")
    table = least_matches(threshold, tolerance)
    docs = only(docs, "doc_id", "text")
    signed = scratch.save(docs.mapInArrow(_sign, "doc_id long, class binary, signature binary"), "signed")
    # One row for each class; combined before the shuffle, so a class of a third of all rows is a row per task.
    members = signed.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("copy_of"), F.any_value("signature").alias("signature"))
    members = scratch.save(members.select(F.monotonically_increasing_id().alias("node"), "class", "copy_of", "signature"), "members")
    # Buckets with the same members are looked at once.
    shared = _buckets(members).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("mark"), F.min("node").alias("low"), F.max("node").alias("high"),
    ).filter("n > 1").groupBy("n", "mark", "low", "high").agg(F.min("bucket").alias("bucket"))
    near = scratch.save(_buckets(members).join(shared.select("bucket"), "bucket", "left_semi"), "near")
    cells = in_blocks(near, "bucket").select("cell", "side", "node").join(members.select("node", "signature"), "node")
    edges = scratch.save(_by_cell(cells).mapInArrow(_attach(table), "a long, b long"), "edges")
    groups = components(edges, scratch, "groups")
    # The n-grams are made anew from the texts of the few classes that have a possible neighbour.
    wanted = members.join(groups, "node").select("node", "root", "signature", "class", F.col("copy_of").alias("first"))
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("first"))).select("node", "root", "signature", "class", "text")
    sets = texts.mapInArrow(_with_grams, "node long, root long, signature binary, grams array<long>")
    sets = scratch.save(sets.dropDuplicates(["node"]), "sets")
    cells = in_blocks(sets.select("node", "root"), "root").select("cell", "side", "node").join(sets.drop("root"), "node")
    linked = scratch.save(_by_cell(cells).mapInArrow(_verify(table, threshold), "a long, b long, n long"), "linked")
    links = linked.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    found = components(linked.filter("a <> b").select("a", "b"), scratch, "classes")
    ids = members.select("node", "class", "copy_of")
    named = found.join(ids, "node").groupBy("root").agg(F.min("copy_of").alias("class_id"))
    linked_to = found.join(named, "root").select("node", "class_id").join(links, "node", "left")
    by_class = ids.join(linked_to, "node", "left").select(
        "class", "copy_of", F.coalesce("class_id", "copy_of").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    own = F.col("class").isNull()
    return signed.select("doc_id", "class").join(by_class, "class", "left").select(
        "doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(own, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _by_cell(cells: DataFrame) -> DataFrame:
    """All rows of a cell in one task, one after the other."""
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, "cell").sortWithinPartitions("cell")
