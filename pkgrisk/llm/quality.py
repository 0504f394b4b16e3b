"""Quality classifier: naive Bayes support vectors.

A document is the set of its n-grams (one and two tokens, and the writing shape of tokens).  Tokens too long for a feature of their own,
such as texts of scripts without spaces, give all their groups of three code points instead.  Each indicator is scaled by the log
of the ratio of its smoothed class frequencies, and a linear classifier of hinge loss is fitted to the scaled indicators by dual
coordinate descent.  A logistic curve over the margins of rows left out of the fit turns margins into scores.

The fit sees a bounded sample of the labelled training rows (``Settings.fit_rows``), and its features are all n-grams that enough
documents of the sample hold.  Their class frequencies are counted over all labelled training rows, in Spark.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from math import fsum, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgrisk.llm.text import only
from pkgrisk.session import Scratch


# n-grams that a task counts before it hands the counts on.
TALLY_ROWS = 150_000
# Code points of a piece of a long token, and of a piece of a long shape.
PIECE = 3
SHAPE = 12
# Labels of 20 bytes that may be broadcast.
BROADCAST_LABELS = 1_000_000


@dataclass(frozen=True)
class Settings:
    fit_rows: int = 12_000  # bound of the rows that the coordinate descent sees
    min_docs: int = 3  # documents of these rows that hold an n-gram
    smoothing: float = 1.0
    penalty: float = 0.05
    epochs: int = 12
    longest: int = 40  # code points of a token that is a feature of its own; longer ones are cut into pieces
    seed: int = 7


def _shape(token: str) -> str:
    """Case and signs of a token: 'Word.' is 'Xx.', 'WORD!!' is 'X!', 'word***' is 'x*'."""
    out = []
    for c in token:
        k = "X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


class _Shapes(dict):
    """Shapes of tokens seen; starts anew when full."""

    def __missing__(self, token: str) -> str:
        if len(self) > 50_000:
            self.clear()
        made = _plain_shape(token) or _shape(token)
        if len(token) <= 40:
            self[token] = made
        return made


def _plain_shape(token: str) -> str:
    """The shape of letters that are all small but for the first, with at most one sign after them; empty for others."""
    stem, end = (token, "") if token.isalpha() else (token[:-1], token[-1])
    if not stem.isalpha():
        return ""
    end = "0" if end.isdigit() else end
    if stem.islower():
        return "x" + end
    return "Xx" + end if stem[0].isupper() and stem[1:].islower() else ""


_shapes = _Shapes()


def features(text: str | None, longest: int = 40) -> tuple[set[str], set[tuple[str, str]]]:
    """The features of a text: tokens, shapes, pairs of shapes, share of repeats and size in powers of two; and pairs of tokens.

    Of a token over ``longest`` code points every piece counts as a token; its pairs are those of its first and last piece.  Shapes
    over SHAPE signs are cut into overlapping pieces.
    """
    tokens = (text or "").split()
    shapes = ["x" if t.islower() and t.isalpha() else _shapes[t] for t in tokens]
    out = set(tokens)
    size, firsts, lasts = len(tokens), tokens, tokens
    long = [t for t in out if len(t) > longest]
    if long:
        out.difference_update(long)
        for t in long:
            out.update("\0c" + t[i : i + PIECE] for i in range(len(t) - PIECE + 1))
        size += sum(len(t) - PIECE for t in tokens if len(t) > longest)
        firsts = [t if len(t) <= longest else "\0c" + t[:PIECE] for t in tokens]
        lasts = [t if len(t) <= longest else "\0c" + t[-PIECE:] for t in tokens]
    seen = len(out)
    for s in set(shapes):
        if len(s) <= SHAPE:
            out.add("\0s" + s)
        else:
            out.update("\0s" + s[i : i + SHAPE] for i in range(0, len(s) - SHAPE // 2, SHAPE // 2))
    out.update([f"\0p{a[-SHAPE:]} {b[:SHAPE]}" for a, b in set(zip(shapes, shapes[1:]))])
    if tokens:
        out.add(f"\0r{round(8 * seen / size)}")
    out.add(f"\0n{size.bit_length()}")
    return out, set(zip(lasts, firsts[1:]))


def grams(text: str | None, longest: int = 40) -> set[str]:
    """All features as texts; tokens hold no space, so a pair is its tokens with one between them."""
    out, pairs = features(text, longest)
    return out.union([f"{a} {b}" for a, b in pairs])


def _apart(names: Iterable[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """Names of features, those of pairs of tokens as pairs."""
    singles, pairs = [], []
    for name in names:
        a, between, b = name.partition(" ")
        if between and not name.startswith("\0p"):
            pairs.append((a, b))
        else:
            singles.append(name)
    return singles, pairs


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    longest: int = 40

    @cached_property
    def _by_kind(self) -> list[tuple[frozenset, dict]]:
        singles, pairs = _apart(self.weights)
        both = {g: self.weights[g] for g in singles}, {(a, b): self.weights[f"{a} {b}"] for a, b in pairs}
        # Sets meet sets without hashing anything again.
        return [(frozenset(w), w) for w in both]

    def settle(self) -> None:
        """Keeps the weights by kind alone, for workers that only score."""
        if self._by_kind:
            self.weights = {}

    def margin(self, text: str | None) -> float:
        found: list[float] = []
        for own, (known, weights) in zip(features(text, self.longest), self._by_kind, strict=True):
            found += map(weights.__getitem__, own & known)
        # Indicators are divided by the root of their number, in the fit as well, so long texts do not outweigh short ones.
        return self.bias + fsum(found) / sqrt(len(found)) if found else self.bias

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(text) + self.shift, -30, 30))))


def train_rows(docs: DataFrame, labels: DataFrame, label: str, keep: Column) -> DataFrame:
    """``doc_id, text, y``: labelled documents; rows without id, label, or outside ``keep`` are left out.

    Of several labels of one document the largest counts; texts of one id all get it.  Up to BROADCAST_LABELS labels go to the
    texts; beyond that both are shuffled.
    """
    given = only(labels, "doc_id", label).filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & keep)
    given = given.groupBy("doc_id").agg(F.max(label).alias(label))
    if given.count() <= BROADCAST_LABELS:
        given = F.broadcast(given)
    return only(docs, "doc_id", "text").join(given, "doc_id").select("doc_id", "text", F.col(label).cast("int").alias("y"))


def fit(rows: DataFrame, settings: Settings = Settings()) -> Model:
    """Fits a model to ``doc_id, text, y``.  With rows of one class or none, every score is that class's share (0.5 for none)."""
    rows = rows.select("doc_id", "text", "y")
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    positive, negative = totals.get(1, 0), totals.get(0, 0)
    if not positive or not negative:
        share = 0.5 if not positive + negative else (positive + 0.5) / (positive + negative + 1)
        return Model(shift=float(np.log(share / (1 - share))), slope=0.0, longest=settings.longest)
    longest, spark = settings.longest, rows.sparkSession
    # Each class gives at most half of the sample.
    half, scratch = settings.fit_rows // 2, Scratch(rows.sparkSession, "quality")
    rows = rows.withColumn("order", F.xxhash64("doc_id", F.lit(settings.seed)))
    parts = [_hashed_first(rows.filter(F.col("y") == y), half, totals[y]) for y in (0, 1)]
    sample = scratch.save(parts[0].unionByName(parts[1]), "sample")
    grams_of = _counts(sample, longest).filter(F.col("n") >= settings.min_docs).select("gram")
    names = {g: i for i, g in enumerate(sorted(grams_of.toArrow().column(0).to_pylist()))}
    shared = spark.sparkContext.broadcast(names)
    # Counts of all rows, for the features alone: a task hands on a row for each of them at most.
    counted = _counts(rows, longest, shared).toArrow()
    a, at = settings.smoothing, np.array([names[g] for g in counted.column("gram").to_pylist()], np.int64)
    n, p = (counted.column(c).to_numpy() for c in ("n", "p"))
    scale = np.zeros(len(names))
    scale[at] = np.log((p + a) / (positive + 2 * a) / ((n - p + a) / (negative + 2 * a)))

    def indicators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            own = [sorted({index[g] for g in grams(t.as_py(), longest) if g in index}) for t in batch.column("text")]
            aside = [zlib.crc32(str(i).encode()) % 4 == 1 for i in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("order"), batch.column("y"), pa.array(aside), pa.array(own, pa.list_(pa.int32()))], names=["order", "y", "aside", "found"]
            )

    # Only numbers of the sample come to the driver, in an order that does not depend on partitions.
    numbers = sample.mapInArrow(indicators, "order long, y int, aside boolean, found array<int>").orderBy("order", "y", "found").toArrow()
    lists = numbers.column("found").combine_chunks()
    found = np.split(lists.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(lists).to_numpy())[:-1])
    y = np.where(numbers.column("y").to_numpy() == 1, 1, -1)
    aside = numbers.column("aside").to_numpy()
    shared.unpersist()
    w, bias = descend([f for f, s in zip(found, aside) if not s], y[~aside], scale, settings)
    margins = np.array([_margin(w, bias, scale, f) for f, s in zip(found, aside) if s])
    # The sample's shares are undone by weighting each class to its share among all rows.
    weight = np.where(y[aside] > 0, positive / max(1, (y > 0).sum()), negative / max(1, (y < 0).sum()))
    slope, shift = logistic(margins, y[aside] > 0, weight)
    w, bias = descend(found, y, scale, settings)
    return Model({g: float(w[i] * scale[i]) for g, i in names.items() if w[i] and scale[i]}, float(bias), slope, shift, longest)


def _counts(rows: DataFrame, longest: int, wanted: Broadcast | None = None) -> DataFrame:
    """``gram, n, p``: documents and documents of label 1 that hold each n-gram, or each wanted one."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Counts are combined before they are shuffled; a full table is handed on.
        n, p = Counter(), Counter()
        own = None if wanted is None else [frozenset(w) for w in _apart(wanted.value)]
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                for k, found in enumerate(features(text.as_py(), longest)):
                    if own is not None:
                        found &= own[k]
                    n.update(found)
                    if y:
                        p.update(found)
                # Wanted n-grams are few enough to be kept to the end.
                if own is None and len(n) > TALLY_ROWS:
                    yield _tallied(n, p)
                    n, p = Counter(), Counter()
        yield _tallied(n, p)

    counted = rows.select("text", "y").mapInArrow(tally, "gram string, n long, p long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))


def _tallied(n: Counter, p: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"gram": [g if isinstance(g, str) else f"{g[0]} {g[1]}" for g in n], "n": list(n.values()), "p": [p[g] for g in n]},
        schema=pa.schema([("gram", pa.string()), ("n", pa.int64()), ("p", pa.int64())]),
    )


def _hashed_first(rows: DataFrame, n: int, of: int) -> DataFrame:
    """The first ``n`` of ``of`` rows by their ``order``, a hash; rows of one id have one hash and stay together.

    Only hashes are sorted, a little over ``n`` of them.
    """
    if n >= of:
        return rows
    low = rows.filter(F.col("order").bitwiseAND(F.lit(0xFFFFFF)) < int(min(1.0, 1.2 * n / of) * 0x1000000))
    last = low.select("order").orderBy("order").limit(n).agg(F.max("order")).head()[0]
    return low.filter(F.col("order") <= last)


def _margin(w: np.ndarray, bias: float, scale: np.ndarray, found: np.ndarray) -> float:
    return float(bias + (w[found] * scale[found]).sum() / np.sqrt(len(found))) if len(found) else float(bias)


def descend(found: list[np.ndarray], y: np.ndarray, scale: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the squared hinge loss; each class weighs the same in sum."""
    def values(i: int) -> np.ndarray:
        # Made when needed: those of the whole sample take twice as much memory as its n-grams.
        return scale[found[i]] / np.sqrt(max(1, len(found[i])))

    # The bias is one more indicator of value 1.
    w, bias = np.zeros(len(scale)), 0.0
    cost = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * settings.penalty
    ridge = 1 / (2 * cost)
    norm = np.array([v @ v + 1.0 for v in map(values, range(len(found)))]) + ridge
    alpha = np.zeros(len(y))
    random = np.random.default_rng(settings.seed)
    for _ in range(settings.epochs):
        for i in random.permutation(len(y)):
            f, v = found[i], values(i)
            gradient = y[i] * (w[f] @ v + bias) - 1 + ridge[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / norm[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def logistic(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's method with a small ridge."""
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -30, 30)))
        g = np.array([(weight * (p - y) * margins).sum() + 1e-2 * (slope - 1), (weight * (p - y)).sum()])
        v = weight * p * (1 - p)
        h = np.array([[(v * margins**2).sum() + 1e-2, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - np.clip(step[0], -2, 2), shift - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(slope, 1e-3)), float(shift)


def with_quality(docs: DataFrame, model: Model, text: str = "text", name: str = "quality_score") -> DataFrame:
    """All columns and a score from 0 to 1 for each row; null and empty texts have the score of a text without tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        own.settle()
        for batch in batches:
            yield pa.array([own.score(t.as_py()) for t in batch], pa.float64())

    return docs.withColumn(name, F.arrow_udf(scores, "double")(F.coalesce(text, F.lit(""))))
