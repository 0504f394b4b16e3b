"""SentencePiece encoding and decoding as a relational lattice.

Every distinct word of the corpus is encoded once.  Its substrings of bounded length are exploded and joined to the piece table; what
matches are the edges of a lattice, which are grouped by word and folded by a Viterbi pass written as a higher-order aggregate.

The piece file is of the byte-pair kind, so the best path is not the one of the largest sum of scores but the one that merging by rank
ends in.  A path is that one exactly if every two neighbouring pieces are: merging both together must not join anything across their
boundary.  Every prefix of a word has one such path, so the fold keeps one state for each position: it takes the edge that fits behind
the piece which ends where the edge starts.  An edge across the boundary prevents this if its two parts exist at one time and its rank
comes before the merges that use them up; the piece table carries these times for both flanks of each piece.

Encodings of frequent words are broadcast (at most FREQUENT words), those of the rest are joined to the texts that hold them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgrisk.llm.text import only
from pkgrisk.llm.vocabulary import SPACE, pieces, word_pattern
from pkgrisk.session import Scratch

FREQUENT = 200_000
WORDS_PER_PARTITION = 10_000
# Longest word, in code points, that stands for itself as a key; and the block in which longer words are exploded.
LONG_WORD = 64
NEVER = 2**31 - 1
# Bits of a time in a flank; the largest one is that of a part that nothing uses up.
TIME = 24
LAST = 2**TIME - 1


def flank(size: int, born: int, dies: int) -> int:
    """A part at one end of a piece while the piece is made: its length, and when it comes into being and is used up; as one number,
    since every edge of every word carries those of its piece."""
    return size << 2 * TIME | born << TIME | dies


def flank_fields(part: Column) -> tuple[Column, Column, Column]:
    """``size, born, dies`` of a flank."""
    return F.shiftright(part, 2 * TIME), F.shiftright(part, TIME).bitwiseAND(F.lit(LAST)), part.bitwiseAND(F.lit(LAST))


class Edge(NamedTuple):
    text: str
    id: int
    rank: int
    left: list[int]
    right: list[int]


def _made(piece: str, rank: dict[str, int]) -> tuple[str, str] | None:
    """The two parts of the last merge that makes a piece from its characters; None if merging does not end in it."""
    symbols, last = list(piece), None
    while len(symbols) > 1:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in rank), default=None)
        if best is None:
            return None
        i = best[1]
        last = symbols[i], symbols[i + 1]
        symbols[i : i + 2] = ["".join(last)]
    return last


def piece_edges(model: str) -> list[Edge]:
    """All pieces that merging can end in; as many as the file has at most."""
    rank = {p.text: round(-p.score) for p in pieces(model) if p.kind == "normal"}
    # Ranks and the time 0 of characters are only compared, so their order numbers do.
    order = {r: n for n, r in enumerate(sorted({0, *rank.values()}))}
    rank = {p: order[r] for p, r in rank.items()}
    ids = {p.text: p.id for p in pieces(model) if p.kind == "normal"}
    parts = {p: _made(p, rank) for p in rank if len(p) > 1}
    times: dict[str, int] = {}

    def time(p: str) -> int:
        """When a part comes into being: at its rank, but not before its own parts."""
        if len(p) == 1:
            return 0
        if p not in times:
            a, b = parts[p]
            times[p] = max(rank[p], time(a), time(b))
        return times[p]

    def flanks(p: str, side: int) -> list[int]:
        out, dies = [], LAST
        while True:
            out.append(flank(len(p), time(p), dies))
            if len(p) == 1:
                return out
            dies, p = time(p), parts[p][side]

    return [Edge(p, ids[p], rank[p], flanks(p, 0), flanks(p, 1)) for p in rank if len(p) == 1 or parts[p]]


def words_of(text: Column, model: str) -> Column:
    """Words of a text with a space in front; the space's own piece character is a space.  An empty text has none."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit(SPACE), F.lit(" "))
    return F.regexp_extract_all(F.when(text == "", text).otherwise(F.concat(F.lit(" "), text)), F.lit(word_pattern(model)), F.lit(0))


def piece_table(spark: SparkSession, model: str) -> DataFrame:
    edges = piece_edges(model)
    # Columns are smaller than rows, in the driver's Python as well as on their way.
    return spark.createDataFrame(pa.table({
        "piece": pa.array([e.text.replace(SPACE, " ") for e in edges], pa.string()), "id": pa.array([e.id for e in edges], pa.int32()),
        "rank": pa.array([e.rank for e in edges], pa.int32()), "left": pa.array([e.left for e in edges], pa.list_(pa.int64())),
        "right": pa.array([e.right for e in edges], pa.list_(pa.int64())),
    }))


def word_key(word: Column) -> Column:
    """A word, or a digest of a long one, so that its edges need not carry it."""
    return F.when(F.length(word) <= LONG_WORD, word).otherwise(F.concat(F.lit("\x00 "), F.sha2(word, 256)))


def lattice(words: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """``key, end, start, id, rank, left, right``: edges of each ``key, word``; a character that is no piece has its code point as
    ``-1 - id``.  ``start`` and ``end`` count code points."""
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.length("word") - 1) / LONG_WORD).cast("int")))
    cut = words.select("key", "word", blocks.alias("block")).select(
        "key", (F.col("block") * LONG_WORD).alias("base"), F.expr(f"substring(word, block * {LONG_WORD} + 1, {LONG_WORD + longest - 1})").alias("text")
    )
    starts = cut.select("key", "base", "text", F.explode(F.sequence(F.lit(1), F.least(F.length("text"), F.lit(LONG_WORD)))).alias("at"))
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("text") - F.col("at") + 1)))
    subs = starts.select("key", "base", "text", "at", sizes.alias("size")).select(
        "key", (F.col("base") + F.col("at") - 1).alias("start"), "size", F.expr("substring(text, at, size)").alias("piece")
    )
    edges = subs.join(F.broadcast(table), "piece", "left").filter("id is not null or size = 1")
    return edges.select(
        "key", (F.col("start") + F.col("size")).alias("end"), "start",
        F.coalesce("id", -1 - F.ascii("piece")).alias("id"), F.coalesce("rank", F.lit(0)).alias("rank"),
        # A character that is no piece merges with nothing.
        "left", "right",
    )


def viterbi(edges: Column) -> Column:
    """For each position of a word the number of the edge on the path that ends there; edges are sorted by end, then start."""

    def item(i: Column) -> Column:
        return F.get(edges, i)

    def step(path: Column, edge: Column) -> Column:
        n, start, end = edge["n"], edge["start"], edge["end"]
        last = F.get(path, start - 1)

        def crosses(c: Column) -> Column:
            def right(x: Column) -> Column:
                size, born, dies = flank_fields(x)

                def left(y: Column) -> Column:
                    own_size, own_born, own_dies = flank_fields(y)
                    return (own_size == c["end"] - start) & (c["rank"] <= own_dies) & (own_born < dies) & (born <= own_dies)

                return (size == start - c["start"]) & (c["rank"] < dies) & F.exists(edge["left"], left)

            return (c["start"] < start) & (c["end"] > start) & F.exists(item(last)["right"], right)

        # Edges across the boundary end behind the piece before it and not behind this edge, so they lie between the two.
        blocked = F.exists(F.slice(edges, last + 2, n - last - 1), crosses)
        longer = F.concat(path, F.array(n))
        return F.when(F.size(path) >= end, path).when(start == 0, longer).when(blocked, path).otherwise(longer)

    return F.aggregate(edges, F.array().cast("array<int>"), step)


def traced(edges: Column, path: Column) -> Column:
    """Ids along the path, read from its end."""
    zero = F.struct(F.size(path).alias("at"), F.array().cast("array<int>").alias("ids"))

    def step(state: Column, position: Column) -> Column:
        edge = F.get(edges, F.get(path, position - 1))
        return F.when(state["at"] != position, state).otherwise(
            F.struct(edge["start"].alias("at"), F.concat(F.array(edge["id"]), state["ids"]).alias("ids"))
        )

    return F.aggregate(F.sequence(F.size(path), F.lit(1), F.lit(-1)), zero, step)["ids"]


def utf8_ids(point: Column, byte_ids: list[int]) -> Column:
    """Byte pieces of a code point."""
    table = F.lit(byte_ids)

    def high(shift: int, mark: int) -> Column:
        return F.get(table, F.shiftright(point, shift).bitwiseOR(F.lit(mark)))

    def low(shift: int) -> Column:
        return F.get(table, F.shiftright(point, shift).bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128)))

    return (
        F.when(point < 0x80, F.array(F.get(table, point))).when(point < 0x800, F.array(high(6, 0xC0), low(0)))
        .when(point < 0x10000, F.array(high(12, 0xE0), low(6), low(0))).otherwise(F.array(high(18, 0xF0), low(12), low(6), low(0)))
    )


def encode_words(words: DataFrame, model: str) -> DataFrame:
    """``key, ids`` for distinct ``key, word``."""
    spark = words.sparkSession
    # A word's edges take some 10 KB while they are grouped; partitions of this size are grouped in memory.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words.count() // WORDS_PER_PARTITION))
    table = piece_table(spark, model)
    longest = max(len(p.text) for p in pieces(model) if p.kind == "normal")
    # Words lie by key from here on, so grouping their edges moves nothing.
    edges = lattice(words.repartition(parts, "key"), table, longest)
    grouped = edges.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("end", "start", "id", "rank", "left", "right"))).alias("edges"))
    numbered = grouped.select("key", F.transform("edges", lambda e, i: F.struct(
        e["end"].alias("end"), e["start"].alias("start"), e["id"].alias("id"), e["rank"].alias("rank"), e["left"].alias("left"), e["right"].alias("right"), i.alias("n"),
    )).alias("edges"))
    paths = numbered.select("key", "edges", viterbi(F.col("edges")).alias("path"))
    byte_ids = [p.id for p in sorted((p for p in pieces(model) if p.kind == "byte"), key=lambda p: p.text)]
    ids = traced(F.col("edges"), F.col("path"))
    return paths.select("key", ids.alias("ids")).select(
        "key", F.when(F.exists("ids", lambda i: i < 0), F.flatten(F.transform("ids", lambda i: F.when(i >= 0, F.array(i)).otherwise(utf8_ids(-1 - i, byte_ids))))).otherwise(F.col("ids")).alias("ids")
    )


class _Frequent:
    """Frequent words and their ids, sent as columns; a worker makes a dictionary of them once, and the driver none."""

    def __init__(self, table: pa.Table):
        self._table = table

    @cached_property
    def ids(self) -> dict[str, list[int]]:
        own, self._table = self._table, None
        return dict(zip(own.column("word").to_pylist(), own.column("ids").to_pylist(), strict=True))


class _Dictionary:
    """Ids of texts from the ids of their words: the common ones, and those that come with a text."""

    def __init__(self, model: str, common: dict[str, list[int]]):
        self._words, self._common = re.compile(word_pattern(model)).findall, common
        self._seen: dict[str, list[int]] = {}

    def _between(self, part: str, rare: dict[str, list[int]]) -> list[int]:
        """Ids of what stands between two spaces; kept if it consists of common words."""
        words = self._words(" " + part)
        common = list(map(self._common.get, words))
        if None not in common:
            ids = list(chain.from_iterable(common))
            if len(self._seen) >= FREQUENT:
                self._seen = {}
            self._seen[part] = ids
            return ids
        return list(chain.from_iterable(rare[w] if i is None else i for w, i in zip(words, common, strict=True)))

    def ids(self, text: str, rare: dict[str, list[int]]) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        text = text.replace(SPACE, " ")
        parts = text.split(" ")
        if "" in parts:
            found = [self._common.get(w) or rare[w] for w in self._words(" " + text)]
        else:
            found = list(map(self._seen.get, parts))
            if None in found:
                found = [self._between(p, rare) if i is None else i for p, i in zip(parts, found, strict=True)]
        return np.fromiter(chain.from_iterable(found), np.int32)


def _applied(model: str, frequent):
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        own = _Dictionary(model, frequent.value.ids)
        for texts, words, ids in batches:
            out = [
                own.ids(t.as_py(), dict(zip(w.as_py(), i.as_py(), strict=True)) if w.is_valid else {})
                for t, w, i in zip(texts, words, ids, strict=True)
            ]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *out])))

    return F.arrow_udf(run, "array<int>")


def encode(docs: DataFrame, model: str, text: str = "text", name: str = "ids", frequent: int = FREQUENT) -> DataFrame:
    """All columns of ``docs`` and the piece ids of each text, as the model's own library gives them without special tokens.

    Null and empty texts have no ids; every input row gives one row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pieces")
    names = docs.columns
    # Only words are kept by this key, so rows that share it share nothing but a larger list of words.
    keyed = docs.withColumn("__row", F.xxhash64(F.col(f"`{text}`")))
    counts = only(docs, text).select(F.explode(words_of(F.col(f"`{text}`"), model)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = scratch.save(counts.select(word_key(F.col("word")).alias("key"), "word", "n"), "words")
    encoded = scratch.save(encode_words(counts.select("key", "word"), model), "encoded")
    # The count that at most ``frequent`` words reach.
    by_count = counts.filter(F.length("word") <= LONG_WORD).groupBy(F.ceil(F.log2("n") * 8).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("n").alias("least")).orderBy(F.desc("level")).collect()
    taken, least = 0, NEVER
    for row in by_count:
        taken += row["n"]
        if taken > frequent:
            break
        least = row["least"]
    common = counts.filter((F.col("n") >= least) & (F.length("word") <= LONG_WORD)).select("key", "word")
    # One job for all of them; an iterator would run one for each partition.
    shared = spark.sparkContext.broadcast(_Frequent(common.join(encoded, "key").select("word", "ids").toArrow()))
    rare_words = counts.filter((F.col("n") < least) | (F.length("word") > LONG_WORD)).select("key", "word")
    pairs = keyed.select("__row", F.explode(F.array_distinct(words_of(F.col(f"`{text}`"), model))).alias("word"))
    pairs = pairs.join(F.broadcast(common.select("word")), "word", "left_anti").select("__row", word_key(F.col("word")).alias("key"))
    # Equal texts give their words once each; the set takes them together, so pairs move to their words and to their texts only.
    own = pairs.join(rare_words.join(encoded, "key"), "key").groupBy("__row").agg(F.collect_set(F.struct("word", "ids")).alias("__own"))
    ids = _applied(model, shared)(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col("__own.word"), F.col("__own.ids"))
    return keyed.join(own, "__row", "left").select(*[F.col(f"`{n}`") for n in names if n != name], ids.alias(name))


def decode(ids: Column, model: str) -> Column:
    """Text of each array of ids; null stays null.  Ids of special tokens have no text; bytes that are no UTF-8 become U+FFFD."""
    table = {p.id: bytes([int(p.text[3:5], 16)]) if p.kind == "byte" else p.text.replace(SPACE, " ").encode() if p.kind == "normal" else b"" for p in pieces(model)}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for row in batch:
                text = b"".join(map(table.__getitem__, row.as_py())).decode("utf-8", "replace") if row.is_valid else None
                # The first space is the one that encoding put there.
                out.append(text[1:] if text and text[0] == " " else text)
            yield pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(ids)
