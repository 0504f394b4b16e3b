"""Token ids as length-delimited binary records, with an offset index beside each file.

A record is framed as length (8 bytes), masked CRC-32C of the length, payload, masked CRC-32C of the payload, all little-endian: the
framing of TFRecord files.  The payload is a ``tf.train.Example`` message with the features ``doc_id`` (left out if null) and
``input_ids``, so that public readers of both formats can read the files.  The index of a file has two 8-byte numbers for each record:
where its frame begins and how long it is.

Documents go to ranges of ``doc_id``; each task sorts, encodes and writes one file and its index under names of its own.  The files that
count are those that the manifest names: it is a Parquet table, so of several attempts of a task just one is in it, and what lost
executors leave behind is never read.
"""

from __future__ import annotations

import os
import string
import struct
import uuid
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgrisk.llm.text import only

MANIFEST = "manifest"
# Frames are written and read in pieces of about this size.
CHUNK_BYTES = 4 << 20
# Ids of words that one worker keeps, in two generations; only speed depends on it.
CACHE_WORDS = 600_000
LONG_WORD = 64
_SIGNS = string.punctuation

# Fixed values of the formats: the reflected polynomial of CRC-32C, what masking adds, and bytes around a payload.
_POLYNOMIAL = 0x82F63B78
_MASK_DELTA = 0xA282EAD8
_HEAD, _TAIL = 12, 4


# --------------------------------------------------------------------------
# Checksums of many byte strings at once


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1)
    return table


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of checksums, given by its values for each byte of them."""
    return tables[0][x & 0xFF] ^ tables[1][(x >> 8) & 0xFF] ^ tables[2][(x >> 16) & 0xFF] ^ tables[3][x >> 24]


@lru_cache(maxsize=64)
def _shift(doublings: int) -> np.ndarray:
    """What ``2 ** doublings`` zero bytes do to a checksum."""
    values = np.arange(256, dtype=np.uint32)
    if not doublings:
        table = _byte_table()
        return np.stack([table if k == 0 else (values << np.uint32(8 * k)) >> 8 for k in range(4)])
    half = _shift(doublings - 1)
    return np.stack([_apply(half, half[k]) for k in range(4)])


@lru_cache(maxsize=1)
def _of_word() -> np.ndarray:
    """Checksum of two bytes, by their place among the four pairs of a word."""
    pairs = np.arange(1 << 16)
    byte = _byte_table()
    last = byte[pairs >> 8] ^ _apply(_shift(0), byte[pairs & 0xFF])
    rows = [last]
    for _ in range(3):
        rows.append(_apply(_shift(1), rows[-1]))
    return np.stack(rows[::-1])


def crc32c(strings: list[bytes]) -> np.ndarray:
    """CRC-32C of each string of at least 4 bytes, in one tree of eight-byte words over all of them.

    Zero bytes in front leave a checksum that starts at zero as it is, so strings are filled up in front and neighbours are
    joined in pairs, level by level: crc(a b) = shift(crc(a)) ^ crc(b).
    """
    if not strings:
        return np.zeros(0, np.uint32)
    sizes = np.array([len(s) for s in strings], np.int64)
    counts = -(-sizes // 8)
    ends = np.cumsum(counts * 8)
    data = np.zeros(int(ends[-1]), np.uint8)
    starts = ends - sizes
    # Strings lie at the ends of their rooms.
    lift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    joined = np.frombuffer(b"".join(strings), np.uint8)
    data[np.arange(len(joined)) + lift] = joined
    for k in range(4):
        data[starts + k] ^= 0xFF
    words, table = data.view("<u2").reshape(-1, 4), _of_word()
    crc = table[0][words[:, 0]]
    for k in range(1, 4):
        crc ^= table[k][words[:, k]]
    level = 3
    while (counts > 1).any():
        odd = counts & 1
        room = np.zeros(int((counts + odd).sum()), np.uint32)
        room[np.arange(len(crc)) + np.repeat(np.cumsum(odd), counts)] = crc
        crc = _apply(_shift(level), room[0::2]) ^ room[1::2]
        counts = (counts + 1) // 2
        level += 1
    return ~crc


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(_MASK_DELTA)


# --------------------------------------------------------------------------
# Payloads


def pack_numbers(numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers from 0 on in groups of seven bits, and where the bytes of each end."""
    size = np.ones(len(numbers), np.int64)
    for bits in range(7, 64, 7):
        more = numbers >> bits > 0
        if not more.any():
            break
        size += more
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - size
    out[starts] = numbers & 0x7F
    for k in range(1, int(size.max(initial=1))):
        on = np.flatnonzero(size > k)
        out[starts[on] + k - 1] |= 0x80
        out[starts[on] + k] = (numbers[on] >> 7 * k) & 0x7F
    return out.tobytes(), ends


def unpack_numbers(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and where the last byte of each lies."""
    bytes_ = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(bytes_ < 0x80)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    size = ends - starts + 1
    out = (bytes_[starts] & 0x7F).astype(np.uint64)
    for k in range(1, int(size.max(initial=1))):
        on = np.flatnonzero(size > k)
        out[on] |= (bytes_[starts[on] + k] & 0x7F).astype(np.uint64) << np.uint64(7 * k)
    return out, ends


def _number(n: int) -> bytes:
    """One number of 64 bits in the same form."""
    n, out = n & (2**64 - 1), bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(tag: int, body: bytes) -> bytes:
    return bytes([tag << 3 | 2]) + _number(len(body)) + body


def _read_number(data: bytes, at: int) -> tuple[int, int]:
    n = bits = 0
    while True:
        byte = data[at]
        at, n, bits = at + 1, n | (byte & 0x7F) << bits, bits + 7
        if byte < 0x80:
            return n, at


def _fields(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Tags and bodies of a message that has delimited fields only."""
    at = 0
    while at < len(data):
        size, begin = _read_number(data, at + 1)
        yield data[at] >> 3, data[begin : begin + size]
        at = begin + size


def _feature(name: bytes, packed: bytes) -> bytes:
    return _field(1, _field(1, name) + _field(2, _field(3, _field(1, packed))))


def as_examples(doc_ids: list[int | None], ids: list[bytes]) -> list[bytes]:
    """One message for each document; ``ids`` are little-endian unsigned 32-bit integers."""
    packed, ends = pack_numbers(np.frombuffer(b"".join(ids), "<u4"))
    cuts = np.concatenate(([0], ends))[np.cumsum([0] + [len(i) // 4 for i in ids])].tolist()
    out = []
    for doc_id, a, b in zip(doc_ids, cuts, cuts[1:], strict=False):
        known = b"" if doc_id is None else _feature(b"doc_id", _number(doc_id))
        out.append(_field(1, known + _feature(b"input_ids", packed[a:b])))
    return out


def from_examples(messages: list[bytes]) -> list[tuple[int | None, bytes]]:
    """``doc_id`` and ids of each message."""
    doc_ids, packed = [], []
    for message in messages:
        found = {}
        for _, features in _fields(message):
            for _, entry in _fields(features):
                parts = dict(_fields(entry))
                found[parts[1]] = dict(_fields(dict(_fields(parts[2]))[3]))[1]
        known = found.get(b"doc_id")
        doc_ids.append(None if known is None else (_read_number(known, 0)[0] + 2**63) % 2**64 - 2**63)
        packed.append(found[b"input_ids"])
    numbers, ends = unpack_numbers(b"".join(packed))
    ids = numbers.astype("<u4").tobytes()
    cuts = (4 * np.searchsorted(ends, np.cumsum([0] + [len(p) for p in packed]))).tolist()
    return [(i, ids[a:b]) for i, a, b in zip(doc_ids, cuts, cuts[1:], strict=False)]


# --------------------------------------------------------------------------
# Frames


def frames(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    sums = masked(crc32c(heads + payloads)).astype("<u4")
    n = len(payloads)
    return [h + sums[i].tobytes() + p + sums[n + i].tobytes() for i, (h, p) in enumerate(zip(heads, payloads, strict=True))]


def payloads_of(framed: list[bytes]) -> list[bytes]:
    """Payloads of whole frames; a wrong length or checksum is an error."""
    heads, out = [f[:8] for f in framed], [f[_HEAD:-_TAIL] for f in framed]
    sums = masked(crc32c(heads + out)).astype("<u4")
    n = len(framed)
    for i, f in enumerate(framed):
        if struct.unpack("<Q", heads[i])[0] != len(out[i]) or f[8:_HEAD] != sums[i].tobytes() or f[-_TAIL:] != sums[n + i].tobytes():
            raise ValueError("damaged record")
    return out


# --------------------------------------------------------------------------
# Encoding


class WordIds:
    """Ids of texts by one file of the tokenizers library, without special tokens around them.

    If white space alone gives no ids and ends every match, if signs end words and capitals don't matter, a text is its words one
    after the other; each new word is then encoded by the library once and kept.  Other vocabularies get whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._own = Tokenizer.from_file(path)
        self._own.no_truncation()
        self._own.no_padding()
        a, b, dots, *both, space, line = self._library(["a", "b", "..", "a b..", " A\n\nb.. ", " ", "\n"])
        self.by_word = all(x == a + b + dots for x in both) and not space and not line
        self._young: dict[str, bytes] = {"": b""}
        self._old: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self._own.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, from one call for all of them: ids belong to the word in which they start."""
        found = self._own.encode(" ".join(words), add_special_tokens=False)
        ids = array("I", found.ids).tobytes()
        begins = np.cumsum([0] + [len(w) + 1 for w in words])
        cuts = (4 * np.searchsorted(np.array([a for a, _ in found.offsets], np.int64), begins)).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return self._library([text])[0]
        words = text.replace("\n", " ").split(" ")
        parts = list(map(self._young.get, words))
        if None in parts:
            holes = [i for i, p in enumerate(parts) if p is None]
            new = {words[i] for i in holes}
            self._learn(new)
            for i in holes:
                parts[i] = self._young[words[i]]
            for w in new:
                if len(w) > LONG_WORD:
                    del self._young[w]
            if len(self._young) > CACHE_WORDS:
                self._old, self._young = self._young, {"": b""}
        return b"".join(parts)

    def _learn(self, words: set[str]) -> None:
        """Puts the ids of all words among the kept ones."""
        young, old = self._young, self._old
        made, unknown = [], {}
        for w in words:
            ids = old.get(w)
            if ids is not None:
                young[w] = ids
                continue
            stem, tail = _stem(w)
            if stem != w:
                made.append((w, stem, tail))
            for part in (stem, tail):
                if part not in young and part not in unknown:
                    ids = old.get(part)
                    if ids is None:
                        unknown[part] = None
                    else:
                        young[part] = ids
        if unknown:
            young |= zip(unknown, self._words(list(unknown)), strict=True)
        for w, stem, tail in made:
            young[w] = young[stem] + young[tail]


def _stem(word: str) -> tuple[str, str]:
    """Small letters of a Latin word and the signs after it, which are always encoded apart; else the word as it is."""
    stem = word.rstrip(_SIGNS)
    if len(word) <= LONG_WORD and stem.isalpha() and max(stem) < "\u0100":
        return stem.lower(), word[len(stem) :]
    return word, ""


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One encoder a worker."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


# --------------------------------------------------------------------------
# Files


class _Writer:
    """One file of records and its index."""

    def __init__(self, folder: str, name: str):
        fs, path = FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        self._file = fs.open_output_stream(f"{path}/{name}.tfrecord")
        self._index = fs.open_output_stream(f"{path}/{name}.index")
        self._doc_ids: list[int | None] = []
        self._ids: list[bytes] = []
        self._size = self.bytes = self.records = self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._doc_ids.append(doc_id)
        self._ids.append(ids)
        self._size += len(ids)
        self.records += 1
        self.tokens += len(ids) // 4
        if self._size >= CHUNK_BYTES:
            self._flush()

    def _flush(self) -> None:
        done = frames(as_examples(self._doc_ids, self._ids))
        sizes = np.array([len(f) for f in done], np.int64)
        begins = self.bytes + np.cumsum(sizes) - sizes
        self._file.write(b"".join(done))
        self._index.write(np.stack((begins, sizes), axis=1).astype("<u8").tobytes())
        self.bytes += int(sizes.sum())
        self._doc_ids, self._ids, self._size = [], [], 0

    def close(self) -> None:
        self._flush()
        self._file.close()
        self._index.close()


_MANIFEST_SCHEMA = "shard int, name string, records long, tokens long, bytes long"


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Encodes ``doc_id, text``, appends ``end_id`` to each and writes records in ascending order; returns the manifest.

    ``folder`` is one that all executors reach.  Null ids come first, rows of one id go by a hash of the text; null text is empty.
    Repeated rows are all written, an empty table gives a manifest without rows, other columns are not read.  A file is a range, so
    its number in the manifest orders it; ``shards`` is the number of ranges, else Spark's own for a shuffle.
    """
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = (F.asc_nulls_first("doc_id"), "tie")
    rows = (rows.repartitionByRange(shards, *order) if shards else rows.repartitionByRange(*order)).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out, end = encoder(tokenizer), None, struct.pack("<I", end_id)
        shard = TaskContext.get().partitionId()
        name = f"records-{shard:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            out = out or _Writer(folder, name)
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                out.add(doc_id.as_py(), own.packed(text.as_py()) + end)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "name": [name], "records": [out.records], "tokens": [out.tokens], "bytes": [out.bytes]}
            )

    rows.select("doc_id", "text").mapInArrow(run, _MANIFEST_SCHEMA).write.mode("error").parquet(f"{folder}/{MANIFEST}")
    return docs.sparkSession.read.schema(_MANIFEST_SCHEMA).parquet(f"{folder}/{MANIFEST}")


_READ_SCHEMA = "shard int, record long, doc_id long, start long, ids binary"
_READ_ARROW = pa.schema([
    ("shard", pa.int32()), ("record", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())
])


def _files(spark: SparkSession, folder: str) -> list[dict]:
    """The manifest with the number of ids before each file: one row for each file, so at most one for each task that wrote."""
    files, before = [], 0
    for row in spark.read.schema(_MANIFEST_SCHEMA).parquet(f"{folder}/{MANIFEST}").orderBy("shard").collect():
        files.append({"shard": row["shard"], "name": row["name"], "before": before})
        before += row["tokens"]
    return files


def _chunks(index: np.ndarray) -> Iterable[np.ndarray]:
    """Neighbouring rows of an index, about CHUNK_BYTES together."""
    part = (index[:, 0] - index[:1, 0]) // CHUNK_BYTES
    return np.split(index, np.flatnonzero(np.diff(part)) + 1) if len(index) else []


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records in the order of the files: ``shard, record, doc_id, start, ids``.

    ``record`` counts from 0 in each file, ``start`` is the number of ids in all records before it, ``ids`` holds little-endian
    unsigned 32-bit integers.  One task a file; checksums are verified, and a damaged record is an error.
    """
    files = _files(spark, folder)
    todo = spark.createDataFrame([(f["shard"], f["name"], f["before"]) for f in files], "shard int, name string, before long").repartition(max(1, len(files)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                start, n = row["before"], 0
                with fs.open_input_stream(f"{path}/{row['name']}.index") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 2).astype(np.int64)
                with fs.open_input_stream(f"{path}/{row['name']}.tfrecord") as f:
                    for chunk in _chunks(index):
                        out = []
                        for doc_id, ids in from_examples(payloads_of([f.read(int(size)) for size in chunk[:, 1]])):
                            out.append((row["shard"], n, doc_id, start, ids))
                            start, n = start + len(ids) // 4, n + 1
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _READ_ARROW.types)], schema=_READ_ARROW)

    return todo.mapInArrow(run, _READ_SCHEMA)


def read_shuffled(spark: SparkSession, folder: str, seed: int, tasks: int | None = None) -> DataFrame:
    """``shard, record, doc_id, ids`` in an order that ``seed`` fixes, by way of the indexes: tasks read single records of all files.

    Only index rows are shuffled; a task reads its records in the order of their hash, so any number of files can be mixed without
    moving ids between executors.
    """
    files = _files(spark, folder)
    names = spark.createDataFrame([(f["shard"], f["name"]) for f in files], "shard int, name string").repartition(max(1, len(files)))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_stream(f"{path}/{row['name']}.index") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 2).astype(np.int64)
                for at in range(0, len(index), 10_000):
                    part = index[at : at + 10_000]
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array([row["shard"]] * len(part), pa.int32()), "name": [row["name"]] * len(part),
                        "record": np.arange(at, at + len(part)), "at": part[:, 0], "size": part[:, 1],
                    })

    rows = names.mapInArrow(places, "shard int, name string, record long, at long, size long").withColumn("mix", F.xxhash64(F.lit(seed), "shard", "record"))
    rows = (rows.repartitionByRange(tasks, "mix", "shard", "record") if tasks else rows.repartitionByRange("mix", "shard", "record")).sortWithinPartitions("mix", "shard", "record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = FileSystem.from_uri(folder)
        opened: dict[str, pa.NativeFile] = {}
        for batch in batches:
            rows_, at = batch.to_pylist(), 0
            while at < len(rows_):
                framed, size, first = [], 0, at
                while at < len(rows_) and size < CHUNK_BYTES:
                    row = rows_[at]
                    if len(opened) >= 64 and row["name"] not in opened:
                        opened.pop(next(iter(opened))).close()
                    f = opened.get(row["name"]) or opened.setdefault(row["name"], fs.open_input_file(f"{path}/{row['name']}.tfrecord"))
                    framed.append(f.read_at(row["size"], row["at"]))
                    size, at = size + row["size"], at + 1
                out = [(r["shard"], r["record"], *found) for r, found in zip(rows_[first:at], from_examples(payloads_of(framed)), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([o[0] for o in out], pa.int32()), "record": pa.array([o[1] for o in out], pa.int64()),
                    "doc_id": pa.array([o[2] for o in out], pa.int64()), "ids": pa.array([o[3] for o in out], pa.binary()),
                })

    return rows.drop("mix").mapInArrow(run, "shard int, record long, doc_id long, ids binary")
