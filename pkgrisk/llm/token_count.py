"""Token counts of a byte-pair vocabulary without emitting tokens.

A word's symbols form a linked list; a heap holds its adjacent pairs by rank.  The pair of the lowest rank is merged again and
again, and the count is the number of first symbols less the number of merges.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgrisk.llm.vocabulary import SPACE, pieces, word_pattern

# Counts that one worker keeps, in two generations; only speed depends on it.
CACHE_WORDS = 300_000
LONG_WORD = 64


class PieceCounter:
    """Counts the pieces of one vocabulary file."""

    def __init__(self, model: str):
        self._rank: dict[str, float] = {}
        for piece in pieces(model):
            if piece.kind == "normal":
                self._rank[piece.text] = -piece.score
        self._parts_of = re.compile(word_pattern(model)).findall
        self._words, self._parts = _Memory(), _Memory()

    def symbols(self, word: str) -> int:
        """Tokens of characters that merges may join; spaces are written as the vocabulary writes them."""
        rank = self._rank
        symbols: list[str | None] = list(word)
        n = len(symbols)
        heap = [(r, i, pair) for i, pair in enumerate(map(add, word, word[1:])) if (r := rank.get(pair)) is not None]
        # A character outside the vocabulary is written as its UTF-8 bytes.
        count = n if all(map(rank.__contains__, word)) else sum(1 if c in rank else len(c.encode("utf-8", "surrogatepass")) for c in word)
        if not heap:
            return count
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heapify(heap)
        while heap:
            _, i, made = heappop(heap)
            left, j = symbols[i], after[i]
            # A pair whose parts were merged meanwhile is out of date.
            if left is None or j >= n or left + symbols[j] != made:
                continue
            count -= 1
            symbols[i], symbols[j] = made, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                pair = made + symbols[k]
                if (r := rank.get(pair)) is not None:
                    heappush(heap, (r, i, pair))
            h = before[i]
            if h >= 0:
                pair = symbols[h] + made
                if (r := rank.get(pair)) is not None:
                    heappush(heap, (r, h, pair))
        return count

    def part(self, part: str) -> int:
        n = self._parts.get(part)
        if n is None:
            n = self.symbols(part.replace(" ", SPACE))
            if len(part) <= LONG_WORD:
                self._parts.put(part, n)
        return n

    def word(self, word: str) -> int:
        """Tokens of a run of spaces and what follows up to the next space."""
        return sum(map(self.part, self._parts_of(word)))

    def _new_word(self, word: str) -> int:
        n = self._words.old.get(word)
        if n is None:
            n = self.word(" " + word)
        if len(word) <= LONG_WORD:
            self._words.put(word, n)
        return n

    def text(self, text: str) -> int:
        """Tokens of a text.  No piece holds a space after another character, so words are counted on their own."""
        if not text:
            return 0
        parts = text.replace(SPACE, " ").split(" ")
        if "" not in parts:
            counts = list(map(self._words.young.get, parts))
            if None in counts:
                counts = [self._new_word(part) if n is None else n for part, n in zip(parts, counts, strict=True)]
            return sum(counts)
        total = spaces = 0
        for part in parts:
            # An empty part is one more space before the next word.
            spaces += 1
            if part:
                total += self.word(" " * spaces + part)
                spaces = 0
        return total + (self.part(" " * spaces) if spaces else 0)


class _Memory:
    """Two generations: what is used stays, what is not goes when the younger one is full."""

    def __init__(self) -> None:
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def get(self, key: str) -> int | None:
        n = self.young.get(key)
        if n is None and (n := self.old.get(key)) is not None:
            self.put(key, n)
        return n

    def put(self, key: str, n: int) -> None:
        if len(self.young) >= CACHE_WORDS:
            self.old, self.young = self.young, {}
        self.young[key] = n


_counters: dict[str, PieceCounter] = {}


def counter(model: str) -> PieceCounter:
    """One counter a worker."""
    if model not in _counters:
        _counters[model] = PieceCounter(model)
    return _counters[model]


def count_tokens(texts: Column, model: str) -> Column:
    """Tokens of each text as ``long``; null counts as empty, an empty text has none."""

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter(model)
        for batch in batches:
            yield pa.array([own.text(t.as_py()) for t in batch], pa.int64())

    return F.arrow_udf(count, "long")(F.coalesce(texts, F.lit("")))


def with_token_counts(docs: DataFrame, model: str, limit: int, text: str = "text") -> DataFrame:
    """All columns and ``n_bytes, n_tokens, over_limit``.  Null text: 0 bytes, 0 tokens, not over the limit."""
    counted = docs.withColumn("n_tokens", count_tokens(F.col(text), model))
    return counted.withColumn("n_bytes", F.octet_length(F.coalesce(text, F.lit(""))).cast("long")).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
