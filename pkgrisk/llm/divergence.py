"""How far the sources of a language differ in their words.

Terms are counted by language and source.  Divergences of all pairs of sources are computed in a cube: a task owns a cell of (group
block, group block, term block), gets the counts of its two blocks of groups for its block of terms, and computes what these terms
add for each pair in it; the parts are then summed along the term axis.  Terms without counts in a cell add the same for each pair
wherever they are, so they are only counted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pkgrisk.llm.text import only
from pkgrisk.session import Scratch

# A term is kept if so many documents of its language hold it.
LEAST_DOCUMENTS = 3
TOP_TERMS = 200
# Shares are whole numbers of this unit.
UNIT = 1_000_000_000
# Mean groups and terms of a block: a cell has a table of twice the first times the second.
GROUP_BLOCK = 32
TERM_BLOCK = 4096
# Terms that one task counts before it hands them on.
TALLY_TERMS = 300_000

# Bytes of a term: letters and everything outside ASCII, A-Z lower-cased.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term, and a row of the empty term for each group.

    Null text, language and source are empty.  A row is a document, repeated ids or not.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, held) in groups.items():
                terms = list(n)
                for at in range(0, len(terms), 50_000):
                    part = terms[at : at + 50_000]
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([lang] * len(part), pa.binary()).cast(pa.string()), "source": pa.array([source] * len(part), pa.binary()).cast(pa.string()),
                        "term": pa.array(part, pa.binary()).cast(pa.string()),
                        "n": pa.array([n[t] for t in part], pa.int64()), "docs": pa.array([held[t] for t in part], pa.int64()),
                    })
            groups.clear()

        for batch in batches:
            texts, langs, sources = (batch.column(c).cast(pa.binary()) for c in ("text", "lang", "source"))
            size = 0
            for text, lang, source in zip(texts, langs, sources, strict=True):
                n, held = groups.setdefault((lang.as_py(), source.as_py()), (Counter({b"": 0}), Counter({b"": 0})))
                words = text.as_py().translate(_FOLD).split()
                size -= len(n)
                n.update(words)
                size += len(n)
                held.update(set(words))
                if size > TALLY_TERMS:
                    yield from handed_on()
                    size = 0
            # What is left of a batch stays for the next one unless it has grown too large.
            if sum(len(n) for n, _ in groups.values()) > TALLY_TERMS:
                yield from handed_on()
        yield from handed_on()

    rows = only(docs, "text", "lang", "source").select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counted = rows.mapInArrow(tally, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + kept)), without overflow."""
    return F.lit(1) + F.call_function("div", (n + 1).cast("decimal(19,0)") * UNIT, (total + kept).cast("decimal(19,0)"))


def _shares(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The same by long division in three steps, so that products stay below 64 bits."""
    rest, out = n + 1, np.zeros_like(n)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def _excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


_CELL = "lang string, source string, item string, value long, terms long, rest long, kept long"
_CELL_ARROW = pa.schema([(n, pa.string()) for n in ("lang", "source", "item")] + [(n, pa.int64()) for n in ("value", "terms", "rest", "kept")])


def _cell(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Rows of a cell: for each group one without a term, which names it, and one for each count."""
    lang, left, right, _ = (k.as_py() for k in key)
    is_group = table.column("term").is_null()
    groups, counts = table.filter(is_group), table.filter(pa.compute.invert(is_group))
    names, block = groups.column("source").to_pylist(), groups.column("block").to_numpy()
    kept = int(groups.column("kept")[0].as_py())
    whole = groups.column("total").to_numpy() + kept
    terms = counts.column("term").combine_chunks().dictionary_encode()
    terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
    n = np.zeros((len(terms.dictionary), len(names)), np.int64)
    at = {name: i for i, name in enumerate(names)}
    n[terms.indices.to_numpy(), [at[s] for s in counts.column("source").to_pylist()]] = counts.column("n").to_numpy()
    out: list[tuple] = []
    if kept:
        p, none = _shares(n, whole), _shares(np.zeros(len(names), np.int64), whole)
    for i, name in enumerate(names):
        others = np.flatnonzero((block != block[i]) if left != right else np.arange(len(names)) != i)
        if kept:
            value, rest = _excess(p[:, [i]], p[:, others]).sum(axis=0), _excess(none[i], none[others])
        else:
            value = rest = np.zeros(len(others), np.int64)
        out += [(lang, name, names[j], v, len(n), r, kept) for j, v, r in zip(others, value.tolist(), rest.tolist(), strict=True)]
    return pa.Table.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate(_CELL_ARROW.types)], schema=_CELL_ARROW)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))


def source_divergence(docs: DataFrame, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` over ``text, lang, source``.

    Part ``pair`` has each other source of the language; its value sums (p - q)^2 / q, rounded down for each kept term, with the
    shares p of the source and q of the other one.  Part ``term`` has the terms with a share above the language's, up to rank ``top``.
    Ranks go by value, then by the item's bytes.  Null text, language or source is empty, repeated rows count each, a language
    without kept terms has pairs of value 0, an empty table gives no rows, and other columns are not read.

    A cell's rows do not grow with the tables: blocks are dealt by hash, as many as the language's groups and terms need.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    counts = scratch.save(term_counts(docs), "counts")
    kept = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = scratch.save(kept.filter(F.col("docs") >= LEAST_DOCUMENTS).select("lang", "term", "lang_n"), "kept")

    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    langs = counts.filter("term = ''").groupBy("lang").agg(F.count(F.lit(1)).alias("groups")).join(sizes, "lang", "left").select(
        "lang", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
        F.ceil(F.col("groups") / group_block).alias("blocks"),
        F.greatest(F.ceil(F.coalesce("kept", F.lit(0)) / term_block), F.lit(1)).alias("slices"),
    )
    langs = scratch.save(langs, "langs")

    cut = F.pmod(F.xxhash64("term"), F.col("slices")).alias("slice")
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).alias("block")
    entries = counts.filter("term <> ''").join(kept, ["lang", "term"]).join(langs, "lang")
    entries = scratch.save(entries.select("lang", "source", "term", "n", "lang_n", cut, block, "blocks"), "entries")
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "kept", "lang_total", block, "blocks", "slices"
    )
    # A group's row in each slice of terms: a hot group's terms meet it in many tasks.
    groups = scratch.save(groups.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).drop("slices"), "groups")

    none = F.lit(None)
    rows = groups.select("lang", "source", none.cast("string").alias("term"), none.cast("long").alias("n"), "total", "kept", "slice", "block", "blocks")
    rows = rows.unionByName(entries.select("lang", "source", "term", "n", none.cast("long").alias("total"), none.cast("long").alias("kept"), "slice", "block", "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    rows = rows.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other")).drop("other")
    cells = rows.groupBy("lang", "left", "right", "slice").applyInArrow(_cell, _CELL)
    pairs = cells.groupBy("lang", "source", "item").agg(
        (F.sum("value") + (F.max("kept") - F.sum("terms")) * F.max("rest")).alias("value")
    )

    named = entries.join(groups.drop("block", "blocks"), ["lang", "source", "slice"]).select(
        "lang", "source", F.col("term").alias("item"),
        share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"),
    )
    terms = named.filter("p > q").withColumn("value", F.expr("(p - q) * (p - q) div q"))
    return _ranked(pairs, "pair").unionByName(_ranked(terms, "term").filter(F.col("rank") <= top))
