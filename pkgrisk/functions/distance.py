"""Edit distance with transpositions, for pairs a join has already narrowed down."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# Most edits of a pair that is found by what deletions leave of both names, and keys made at one time.
MAX_DELETED = 4
_KEYS_AT_ONCE = 200_000


def _mixed(n: int) -> int:
    """A 64-bit factor, the same on every worker."""
    n = (n + 1) * 0x9E3779B97F4A7C15 % 2**64
    n = (n ^ n >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    n = (n ^ n >> 27) * 0x94D049BB133111EB % 2**64
    return n ^ n >> 31


@lru_cache(maxsize=None)
def _weights(size: int, longest: int) -> np.ndarray | None:
    """Factors of the letters for each way to leave ``longest - longest // 5`` of ``size``; None if there is none to look at."""
    k = longest // 5
    left = longest - k
    if left > size or k > MAX_DELETED:
        return None
    out = np.zeros((size, len(list(combinations(range(size), left)))), dtype=np.uint64)
    for column, kept in enumerate(combinations(range(size), left)):
        out[list(kept), column] = [_mixed(n) for n in range(left)]
    return out


def deletion_keys(batches: Iterator[pa.RecordBatch], held: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """``key, name`` for each distinct remainder of each name of a batch.

    Names at a distance of at most k keep a common remainder when the longer
    one loses k letters and the other one k less the difference: a swapped pair
    loses a letter on both sides, like a replaced one.  k is a fifth of the
    longer name, so a name has keys for each longer size it may meet.  Keys are
    hashes; names may share one by chance.  With ``held``, the bits of the keys
    of the other side by their remainder, keys that it cannot have are left out.
    """
    for batch in batches:
        names = batch.column(0)
        raw = [t.encode("latin-1", "replace") for t in names.to_pylist()]
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            for longest in range(size, min(size * 5 // 4, MAX_DELETED * 5 + 4) + 1):
                weights = _weights(size, longest)
                if weights is None:
                    continue
                step = max(1, _KEYS_AT_ONCE // weights.shape[1])
                for part in (rows[at : at + step] for at in range(0, len(rows), step)):
                    letters = np.array([list(raw[i]) for i in part], dtype=np.uint64).reshape(len(part), size)
                    keys = np.sort(letters @ weights + np.uint64(_mixed(1000 + longest)), axis=1)
                    new = np.ones(keys.shape, dtype=bool)
                    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
                    if held is not None:
                        bit = np.mod(keys.view(np.int64), 8 * len(held))
                        new &= (held[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[new].view(np.int64)), names.take(pa.array(part[np.nonzero(new)[0]]))], ["key", "name"]
                    )


def _codes(texts: pd.Series, fill: int) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("latin-1", "replace") for t in texts]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    width = int(sizes.max()) if len(sizes) else 0
    grid = np.full((len(raw), width), fill, dtype=np.int16)
    for row, data in enumerate(raw):
        grid[row, : len(data)] = np.frombuffer(data, dtype=np.uint8)
    return grid, sizes


def transposition_distance(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distance of every pair of the batch.

    The table is filled cell by cell, each cell for the whole batch at once.
    """
    count = len(left)
    if count == 0:
        return np.zeros(0, dtype=np.int32)
    a, a_size = _codes(left, -1)
    b, b_size = _codes(right, -2)
    rows, cols = a.shape[1], b.shape[1]
    pair = np.arange(count)
    far = np.int32(rows + cols + 1)

    # One border row and column beyond the usual ones stand for "never seen".
    table = np.empty((rows + 2, cols + 2, count), dtype=np.int32)
    table[0, :, :] = far
    table[:, 0, :] = far
    table[1, 1:, :] = np.arange(cols + 1, dtype=np.int32)[:, None]
    table[1:, 1, :] = np.arange(rows + 1, dtype=np.int32)[:, None]

    seen_row = np.zeros((cols, count), dtype=np.int64)  # last row whose letter is b[j]
    for i in range(1, rows + 1):
        seen_col = np.zeros(count, dtype=np.int64)  # last column whose letter is a[i]
        letter = a[:, i - 1]
        for j in range(1, cols + 1):
            same = letter == b[:, j - 1]
            k, m = seen_row[j - 1], seen_col
            swap = table[k, m, pair] + (i - k - 1) + 1 + (j - m - 1)
            best = np.minimum(table[i, j + 1], table[i + 1, j]) + 1
            np.minimum(best, table[i, j] + np.where(same, 0, 1), out=best)
            table[i + 1, j + 1] = np.minimum(best, swap)
            seen_col = np.where(same, j, seen_col)
        seen_row[letter[None, :] == b.T] = i
    return table[a_size + 1, b_size + 1, pair]


@F.pandas_udf(IntegerType())
def _edit_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    # Pairs of similar size share a table, so sort by size and work in blocks.
    out = np.empty(len(left), dtype=np.int32)
    order = np.argsort(left.str.len().to_numpy() + right.str.len().to_numpy(), kind="stable")
    for start in range(0, len(order), 4096):
        block = order[start : start + 4096]
        out[block] = transposition_distance(left.iloc[block], right.iloc[block])
    return pd.Series(out)


# Marked as not deterministic so that a filter on it does not compute it a second time.
edit_distance = _edit_distance.asNondeterministic()
