"""Similarity digests of improbable features.

Every window of 64 bytes has an entropy.  How many windows of the whole corpus share that entropy tells how rare it is; the rarest
window of each neighbourhood of 64 windows gets a point, and windows of 8 points or more are features.  Texts under 256 bytes have
too few windows to choose from: all their windows of 8 bytes are features.  Features are put, in order, into Bloom filters of 256
bytes, a new one after 160 features.  Two digests are compared filter by filter, by the bits they share
beyond what chance gives.
"""

from __future__ import annotations

from base64 import b64encode
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.llm.text import only, utf8

WIDTH = 64
POINTS = 8
SHORT = 4 * WIDTH
SHORT_WIDTH = 8
FILTER_BYTES = 256
FILTER_FEATURES = 160
HASHES = 5
LEVELS = 1000
# Windows of less entropy (in thousandths of 6 bits) are runs of few symbols, which unrelated texts share.
LEAST = 100

_COUNTS = np.arange(WIDTH + 1)
# c * log2(c) as whole numbers, so that running sums are exact.
_TERMS = np.round(_COUNTS * np.log2(np.maximum(_COUNTS, 1)) * 1024).astype(np.int64)
_MOST = WIDTH * 6 * 1024


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """Entropy of each window, from 0 (one symbol) to LEVELS (all differ); empty below WIDTH bytes."""
    n = len(data)
    if n < WIDTH:
        return np.zeros(0, np.int64)
    order = np.argsort(data, kind="stable")
    # Places sorted by symbol, then position; symbols lie so far apart that a window never reaches the next one.
    place = order + data[order].astype(np.int64) * (n + 2 * WIDTH)
    end = np.searchsorted(place, place + WIDTH)
    at = np.arange(n)
    ahead = np.empty(n, np.int64)
    ahead[order] = end - at  # equal symbols among this one and the 63 after it
    past = np.minimum(end, n - 1)
    end = end + ((end < n) & (place[past] == place + WIDTH))
    behind = np.empty(n, np.int64)
    behind[order] = at - np.cumsum(np.bincount(end, minlength=n + 1))[:n]  # equal symbols among the 64 before it
    first = _TERMS[np.bincount(data[:WIDTH], minlength=256)].sum()
    out, into = ahead[: n - WIDTH], behind[WIDTH:]
    # A window's sum changes by the symbol that goes and the one that comes; if they are equal nothing changes.
    change = np.where(
        data[: n - WIDTH] == data[WIDTH:], 0, _TERMS[out - 1] - _TERMS[out] + _TERMS[np.minimum(into + 1, WIDTH)] - _TERMS[into]
    )
    sums = np.concatenate(([first], first + np.cumsum(change)))
    return (_MOST - sums) * LEVELS // _MOST


def rarity(histogram: np.ndarray) -> np.ndarray:
    """Rank of each entropy level, 1 for the rarest; levels below LEAST come last."""
    order = np.lexsort((np.arange(LEVELS + 1), histogram))
    rank = np.empty(LEVELS + 1, np.int64)
    rank[order] = np.arange(1, LEVELS + 2)
    rank[:LEAST] = LEVELS + 2
    return rank


def select(ranks: np.ndarray) -> np.ndarray:
    """Starts of the windows that are features, in order; at least one if there is a window."""
    n = len(ranks)
    if not n:
        return np.zeros(0, np.int64)
    key = ranks * (1 << 40) + np.arange(n)
    reach = min(WIDTH, n)
    low, size = key, 1
    while size * 2 <= reach:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < reach:
        low = np.minimum(low[: len(low) - (reach - size)], low[reach - size :])
    points = np.bincount(low & ((1 << 40) - 1), minlength=n)
    chosen = np.flatnonzero(points >= min(POINTS, points.max()))
    usable = chosen[ranks[chosen] <= LEVELS + 1]
    return usable if len(usable) else chosen[:1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def feature_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hash of each feature's bytes; a text too short for any window is one feature, an empty one has none."""
    if len(data) < SHORT_WIDTH:
        return np.frombuffer(sha256(data.tobytes()).digest()[:8], np.uint64) if len(data) else np.zeros(0, np.uint64)
    if len(data) < SHORT:
        lanes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, SHORT_WIDTH)).view(np.uint64)
    else:
        lanes = np.lib.stride_tricks.sliding_window_view(data, WIDTH)[starts].view(np.uint64)
    out = np.zeros(len(lanes), np.uint64)
    for i in range(lanes.shape[1]):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + lanes[:, i])
    return out


def filters(hashes: np.ndarray) -> np.ndarray:
    """Chained Bloom filters as rows of bytes."""
    count = -(-len(hashes) // FILTER_FEATURES)
    bits = np.zeros((count, FILTER_BYTES * 8), bool)
    row = np.arange(len(hashes)) // FILTER_FEATURES
    for k in range(HASHES):
        bits[row, (hashes >> np.uint64(11 * k)).astype(np.int64) & (FILTER_BYTES * 8 - 1)] = True
    return np.packbits(bits, axis=1)


def digest(data: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    return filters(feature_hashes(data, select(ranks) if len(data) >= SHORT else ranks[:0]))


def as_text(chain: np.ndarray) -> str:
    return f"{len(chain)}:{b64encode(chain.tobytes()).decode()}"


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the mean, over the filters of the shorter chain, of the best normalised overlap with a filter of the other."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    a, b = a.view(np.uint64), b.view(np.uint64)
    size = FILTER_BYTES * 8
    of_b = np.bitwise_count(b).sum(1).astype(float)
    total = 0.0
    for row in a:
        own = float(np.bitwise_count(row).sum())
        shared = np.bitwise_count(row & b).sum(1)
        most = np.minimum(own, of_b)
        least = own * of_b / size
        total += float(np.clip((shared - least) / np.maximum(most - least, 1e-9), 0, 1).max())
    return total / len(a)


def corpus_rarity(texts: DataFrame) -> np.ndarray:
    """Ranks of entropy levels, from all windows of the column ``text``: LEVELS + 1 counts, whatever the corpus."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(entropy_levels(np.frombuffer(utf8(text.as_py()), np.uint8)), minlength=LEVELS + 1)
        level = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"level": level.astype(np.int32), "n": total[level]})

    counts = np.zeros(LEVELS + 1, np.int64)
    for row in only(texts, "text").mapInArrow(tally, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[row["level"]] = row["n"]
    return rarity(counts)


class _Text:
    def __init__(self, doc_id: int | None, text: str | None, rank: np.ndarray):
        self.doc_id, self.text = doc_id, text or ""
        self.data = np.frombuffer(utf8(self.text), np.uint8)
        self.ranks = rank[entropy_levels(self.data)]
        self.digest = digest(self.data, self.ranks)


def _edited(own: _Text, after: _Text, rank: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The text with its second half taken from the next one, and its digest; only windows over the seam are new."""
    half = len(own.text) // 2
    head, tail = utf8(own.text[: len(own.text) - half]), utf8(after.text[:half])
    data = np.frombuffer(head + tail, np.uint8)
    a, b = len(head) - WIDTH + 1, len(tail) - WIDTH + 1
    seam = data[max(0, len(head) - WIDTH + 1) : len(head) + min(len(tail), WIDTH - 1)] if len(data) >= WIDTH else data[:0]
    ranks = np.concatenate((own.ranks[: max(0, a)], rank[entropy_levels(seam)], after.ranks[: max(0, b)]))
    return head + tail, digest(data, ranks)


_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def _report(own: _Text, after: _Text, rank: np.ndarray) -> dict:
    edited, edited_digest = _edited(own, after, rank)
    return {
        "doc_id": own.doc_id, "n_chars": len(own.text), "edited_sha256": sha256(edited).hexdigest(),
        "fingerprint": as_text(own.digest), "edited_fingerprint": as_text(edited_digest),
        "near_edited": likeness(own.digest, edited_digest), "near_next": likeness(own.digest, after.digest),
    }


def fingerprints(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """``doc_id, fingerprint``: one row per document; null is empty, whose digest has no filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_Text(i, t.as_py(), rank) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([t.doc_id for t in texts], pa.int64()), "fingerprint": [as_text(t.digest) for t in texts]})

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def compare_with_next(docs: DataFrame, rank: np.ndarray, parts: int | None = None) -> DataFrame:
    """Each document's digest beside those of its edited text and of the next document, ascending ``doc_id``.

    Documents go to ranges of ``doc_id``; the first of each range is handed to the range before it too, so that no range needs
    another one.  Null ids come first; rows of equal id follow each other by text.  A table of one row is its own next.
    """
    docs = only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    parts = parts or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 100 * parts).alias("c")).head()["c"] or []
    cuts = sorted(set(cuts)) if parts > 1 else []
    part = F.lit(0)
    if cuts:
        # Number of cuts below the id.
        part = F.coalesce(F.size(F.filter(F.lit(cuts), lambda c: F.col("doc_id") > c)), F.lit(0))
    docs = docs.withColumn("part", part)
    firsts = {r["part"]: r["first"]["doc_id"] for r in docs.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first")).collect()}
    used = sorted(firsts)
    before = {b: a for a, b in zip([used[-1], *used[:-1]], used)} if used else {}
    ahead = docs.sparkSession.createDataFrame([(b, firsts[b], a) for b, a in before.items()], "part int, first long, to int")
    copies = (
        docs.join(F.broadcast(ahead), "part").filter(F.col("doc_id").eqNullSafe(F.col("first")))
        .select("doc_id", "text", F.col("to").alias("part"), F.lit(1).alias("ahead"))
    )
    rows = docs.withColumn("ahead", F.lit(0)).unionByName(copies)
    rows = rows.repartition(parts, "part").sortWithinPartitions("part", "ahead", F.asc_nulls_first("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_part = None, None
        for batch in batches:
            out = []
            ids, parts_, aheads = (batch.column(n).to_pylist() for n in ("doc_id", "part", "ahead"))
            for i, text in enumerate(batch.column("text")):
                if last is None and aheads[i] and parts_[i] == last_part:
                    continue  # a further row of the first id of the next range
                own = _Text(ids[i], text.as_py(), rank)
                if last is not None:
                    out.append(_report(last, own, rank))
                last, last_part = None if aheads[i] else own, parts_[i]
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return rows.mapInArrow(run, _SCHEMA)
