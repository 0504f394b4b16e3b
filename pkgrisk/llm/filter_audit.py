"""What each of five text filters removes, alone and in every order.

Four filters look at one text; the fifth fails what a smaller id already holds.  A counting Bloom sketch of all texts goes first: tasks
count hashes into slices of it, slices are merged, and a text with a counter below two in its slice is certainly unique.  Only possible
repeats are shuffled with their text, for the smallest id of each.  The five flags make a mask, and everything the audit says is a sum
over counts of masks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgrisk.llm.text import only
from pkgrisk.session import Scratch

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 2
SIGNS = b"#$%&*|"

# Counters for each text, counters of a slice (16 bits number them), counters that a text adds to.
COUNTERS_PER_TEXT = 8
SLICE_BITS = 16
PROBES = 3
# Hashes that one task counts before it hands them on.
TALLY_ROWS = 1_000_000
# Rows of one number or digest that may be broadcast.
BROADCAST_ROWS = 1_000_000

_CAPITALS = bytes(range(65, 91))
_INNER = bytes(range(0x80, 0xC0))


def own_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails; words are split at the six ASCII spaces."""
    words = text.split()
    n = len(words)
    length = len(text.translate(None, _INNER))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        (n < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * n) << 1
        | (100 * capitals > MAX_CAPITAL_PERCENT * length) << 2
        | (len(text.translate(None, SIGNS)) < len(text)) << 3
    )


def own_masks(text: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([own_mask(t.as_py()) for t in batch.cast(pa.binary())], pa.int32())

    return F.arrow_udf(run, "int")(text)


# --------------------------------------------------------------------------
# The sketch


def _slots(hashes: np.ndarray) -> np.ndarray:
    """Counters of each hash in its slice, one row for each probe."""
    own = hashes.view(np.uint64)
    return np.stack([(own >> np.uint64(SLICE_BITS * k)) & np.uint64((1 << SLICE_BITS) - 1) for k in range(PROBES)])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of a task's texts, as the places in each slice that were met once and more often."""
    waiting: list[pa.RecordBatch] = []

    def handed_on() -> pa.RecordBatch:
        table = pa.Table.from_batches(waiting)
        slices, hashes = table.column("slice").to_numpy(), table.column("h").to_numpy()
        found, n = np.unique((slices << SLICE_BITS) + _slots(hashes).astype(np.int64), return_counts=True)
        owner = found >> SLICE_BITS
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        once, more = [], []
        for a, b in zip(first, [*first[1:], len(found)], strict=True):
            place, often = found[a:b].astype(np.uint16), n[a:b] > 1
            once.append(place[~often].tobytes())
            more.append(place[often].tobytes())
        return pa.RecordBatch.from_pydict({"slice": owner[first], "once": pa.array(once, pa.binary()), "more": pa.array(more, pa.binary())})

    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= TALLY_ROWS:
            yield handed_on()
            waiting = []
    if sum(b.num_rows for b in waiting):
        yield handed_on()


def _merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Places of a slice whose counters reach two."""
    counter = np.zeros(1 << SLICE_BITS, np.uint8)
    for once, more in zip(table.column("once"), table.column("more"), strict=True):
        counter[np.frombuffer(once.as_py(), np.uint16)] += 1
        counter[np.frombuffer(more.as_py(), np.uint16)] = 2
        np.minimum(counter, 2, out=counter)
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "full": pa.array([np.packbits(counter > 1).tobytes()], pa.binary())})


def _possible(hashes: pa.Table, sketch: pa.Table) -> pa.Table:
    """Hashes all of whose counters reach two."""
    own = hashes.column("h").to_numpy()
    if sketch.num_rows:
        full = np.unpackbits(np.frombuffer(sketch.column("full")[0].as_py(), np.uint8)).astype(bool)
        own = own[full[_slots(own).astype(np.int64)].all(axis=0)]
    return pa.table({"h": pa.array(own, pa.int64())})


def possible_repeats(hashes: DataFrame, rows: int) -> DataFrame:
    """Distinct ``h`` that the sketch cannot clear: those of all repeated texts, and a few more.

    ``hashes`` has a row for each text, ``rows`` their number.  The sketch grows with it and is never whole in one place: a slice
    is merged in one task, from at most one row for each million texts of a task, and asked there once for each distinct hash.
    """
    slices = max(1, -(-rows * COUNTERS_PER_TEXT >> SLICE_BITS))
    keyed = hashes.select("h", F.pmod(F.xxhash64("h"), F.lit(slices)).cast("long").alias("slice"))
    sketch = keyed.mapInArrow(_partial, "slice long, once binary, more binary").groupBy("slice").applyInArrow(_merged, "slice long, full binary")
    asked = keyed.distinct()
    return asked.groupBy("slice").cogroup(sketch.groupBy("slice")).applyInArrow(_possible, "h long")


# --------------------------------------------------------------------------
# Masks and sums


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if the rows of a written table are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic, n``: documents by source, failed filters and labels.

    Null text and source are empty.  A null id is neither smaller nor larger than another; rows of one id do not repeat each
    other.  Of several labels of one document the largest counts; without a label a document is neither good nor toxic.
    """
    scratch = Scratch(docs.sparkSession, "filter-audit")
    text = F.coalesce("text", F.lit(""))
    docs = only(docs, "doc_id", "text", "source")
    marked = only(labels, "doc_id", "quality", "toxic").groupBy("doc_id").agg(
        F.coalesce(F.max("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.max("toxic") == 1, F.lit(False)).alias("toxic")
    )
    facts = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), F.xxhash64(text).alias("h"), F.unhex(F.sha2(text, 256)).alias("digest"), own_masks(text).alias("mask")
    )
    facts = scratch.save(facts, "facts")
    repeats = scratch.save(possible_repeats(facts.select("h"), facts.count()), "repeats")
    held = docs.select("doc_id", text.alias("text")).withColumn("h", F.xxhash64("text")).join(_small(repeats), "h", "left_semi")
    # Whole texts decide; copies are combined before they are shuffled.
    firsts = held.groupBy("text").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    firsts = scratch.save(firsts.select(F.unhex(F.sha2("text", 256)).alias("digest"), "first"), "firsts")
    repeated = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    flagged = facts.join(_small(firsts), "digest", "left").select("doc_id", "part", (F.col("mask") + F.when(repeated, REPEATED).otherwise(0)).alias("mask"))
    counted = flagged.join(marked, "doc_id", "left").groupBy(
        "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    )
    return counted.agg(F.count(F.lit(1)).alias("n"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step; zeros are there too.  An empty table gives no rows.

    What a step does depends on the set of filters before it and on its own filter alone, so 80 sums for each part are enough;
    the 600 steps of all orders then pick theirs by an equal key.  Counts are whole numbers: in the orders of all filters, each
    filter that a document fails is equally often the first of them.
    """
    spark = docs.sparkSession
    counts = mask_counts(docs, labels)
    all_ = (1 << len(FILTERS)) - 1
    cases = [(before, 1 << i) for i in range(len(FILTERS)) for before in range(all_ + 1) if not before >> i & 1]
    case = F.explode(F.lit([f"{a}:{b}" for a, b in cases])).alias("case")
    bit = F.element_at(F.split("case", ":"), 2).cast("int")
    before = F.element_at(F.split("case", ":"), 1).cast("int")
    n, mask = F.col("n"), F.col("mask")
    fails, earlier = mask.bitwiseAND(F.col("bit")) != 0, mask.bitwiseAND(F.col("before")) != 0
    orders = 1
    for k in range(2, len(FILTERS) + 1):
        orders *= k

    def total(condition: Column, value: Column = n) -> Column:
        return F.sum(F.when(condition, value).otherwise(0))

    removed = fails & ~earlier
    sums = counts.withColumn("case", case).withColumns({"before": before, "bit": bit}).groupBy("part", "before", "bit").agg(
        total(~fails & ~earlier).alias("kept"),
        total(removed).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(mask == F.col("bit")).alias("unique_fails"),
        total(removed & F.col("good")).alias("good_lost"),
        total(removed & F.col("toxic")).alias("toxic_lost"),
        total(fails, n * F.call_function("div", F.lit(orders), F.bit_count(mask))).alias("shapley"),
    )
    steps = []
    for order in permutations(FILTERS):
        seen = 0
        for step, letter in enumerate(order, 1):
            steps.append(("".join(order), step, seen, 1 << FILTERS.index(letter)))
            seen |= 1 << FILTERS.index(letter)
    table = spark.createDataFrame(steps, "filter_order string, step int, before int, bit int")
    return sums.join(F.broadcast(table), ["before", "bit"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
