"""Record files, source divergence and the filter audit against plain Python and the tokenizer's library."""

from __future__ import annotations

import pathlib
import re
import struct
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import TEXTS, documents, empty
from pyspark.sql import functions as F

from pkgrisk.llm import divergence, filter_audit, record_files
from pkgrisk.llm.vocabulary import model_path

WORDS = model_path("word_bpe_49k.json")


def library(path=WORDS):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def plain_crc32c(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def plain_masked(data):
    crc = plain_crc32c(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_checksums():
    assert record_files.crc32c([b"123456789"])[0] == 0xE3069283
    rng = np.random.default_rng(1)
    strings = [rng.bytes(int(n)) for n in [4, 5, 7, 8, 9, 15, 16, 17, 63, 64, 65, 1000, *rng.integers(4, 300, 40)]]
    assert record_files.crc32c(strings).tolist() == [plain_crc32c(s) for s in strings]
    assert record_files.crc32c([]).tolist() == []


@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.lists(st.integers(0, 2**32 - 1), max_size=20)), max_size=5))
def test_payloads_come_back(rows):
    packed = [np.array(ids, "<u4").tobytes() for _, ids in rows]
    messages = record_files.as_examples([i for i, _ in rows], packed)
    framed = record_files.frames(messages)
    back = record_files.from_examples(record_files.payloads_of(framed))
    assert [(i, np.frombuffer(ids, "<u4").tolist()) for i, ids in back] == rows


TRICKY = ["", " ", "\n\n", "a", " a\n b\t c ", "it's I'LL we'd", "<|endoftext|>", "x<|startoftext|>y z", "éte ́x", " wide　space line", "ΟΔΟΣ ΣΑΣ Σ", "İstanbul", "Straße, ÉTÉ! µ ªº: don't' Don'T, a''s x.... €, 5. ²; Ab|> ab<|endoftext|>,", "\x1c\x1d\x85", "가 각", "①² ﬁ", "x" * 300, "1234 5.6%", "\U0001f600\U0001f44d\U0001f3fd ok"]


@settings(max_examples=150)
@given(st.lists(st.one_of(st.sampled_from(TRICKY), st.text(max_size=12)), max_size=12), st.sampled_from([" ", "\n", "", "  ", "\r\n", "\t"]))
def test_ids_are_the_librarys(parts, between):
    text = between.join(parts).encode("utf-8", "ignore").decode()
    own = record_files.encoder(WORDS)
    assert own.by_word
    for _ in range(2):  # new words, then kept ones
        assert np.frombuffer(own.packed(text), "<u4").tolist() == library_ids(text)


_LIBRARY = library()


def library_ids(text):
    return _LIBRARY.encode(text, add_special_tokens=False).ids


def test_vocabularies_with_spaces_get_whole_texts():
    path = model_path("byte_bpe_50k.json")
    own = record_files.WordIds(path)
    assert not own.by_word
    text = "two  spaces\n\nand lines "
    assert np.frombuffer(own.packed(text), "<u4").tolist() == library(path).encode(text, add_special_tokens=False).ids


def plain_records(path):
    """Frames of a file, read byte by byte."""
    data, at, out = pathlib.Path(path).read_bytes(), 0, []
    while at < len(data):
        (n,) = struct.unpack("<Q", data[at : at + 8])
        assert struct.unpack("<I", data[at + 8 : at + 12])[0] == plain_masked(data[at : at + 8])
        payload = data[at + 12 : at + 12 + n]
        assert struct.unpack("<I", data[at + 12 + n : at + 16 + n])[0] == plain_masked(payload)
        out.append((at, 16 + n, payload))
        at += 16 + n
    return out


@pytest.mark.parametrize("shards", [1, 4, None])
def test_records_of_odd_rows(spark, tmp_path, shards):
    folder = f"file://{tmp_path}/records"
    manifest = record_files.write_records(documents(spark), folder, WORDS, 1, shards)
    # What a lost attempt leaves is not read.
    (tmp_path / "records" / "records-000000-lost.tfrecord").write_bytes(b"junk")
    want = [(i, library_ids(t or "") + [1]) for i, t in TEXTS]
    rows = record_files.read_records(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((i for i, _ in want), key=lambda i: (i is not None, i or 0))
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == Counter((i, np.array(ids, "<u4").tobytes()) for i, ids in want)
    starts = np.cumsum([0] + [len(r.ids) // 4 for r in rows])
    assert [r.start for r in rows] == starts[:-1].tolist()
    assert manifest.agg(F.sum("tokens"), F.sum("records")).head() == (starts[-1], len(rows))
    crc = record_files.read_records(spark, folder).select(F.crc32("ids").alias("c"), "ids").collect()
    assert all(r.c == zlib.crc32(r.ids) for r in crc)
    for row in manifest.collect():
        frames = plain_records(tmp_path / "records" / f"{row['name']}.tfrecord")
        index = np.frombuffer((tmp_path / "records" / f"{row['name']}.index").read_bytes(), "<u8").reshape(-1, 2)
        assert index.tolist() == [[a, n] for a, n, _ in frames]


def test_shuffled_reads(spark, tmp_path):
    folder = f"file://{tmp_path}/records"
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("number "), F.col("id").cast("string")).alias("text"))
    record_files.write_records(docs, folder, WORDS, 1, 3)
    straight = {r.doc_id: bytes(r.ids) for r in record_files.read_records(spark, folder).collect()}
    a, b, c = ([(r.doc_id, bytes(r.ids)) for r in record_files.read_shuffled(spark, folder, seed, 2).collect()] for seed in (1, 1, 2))
    assert a == b != c
    assert dict(a) == dict(c) == straight and len(a) == 500
    assert [i for i, _ in a] != sorted(straight)


def test_damaged_records_are_errors(spark, tmp_path):
    folder = f"file://{tmp_path}/records"
    record_files.write_records(documents(spark), folder, WORDS, 1, 1)
    (path,) = (tmp_path / "records").glob("*.tfrecord")
    data = bytearray(path.read_bytes())
    data[40] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="damaged record"):
        record_files.read_records(spark, folder).collect()


def test_records_of_an_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/records"
    assert record_files.write_records(empty(spark), folder, WORDS, 1).count() == 0
    assert record_files.read_records(spark, folder).count() == record_files.read_shuffled(spark, folder, 1).count() == 0


# --------------------------------------------------------------------------


def plain_divergence(rows, top=200):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    held, n = Counter(), defaultdict(Counter)
    for lang, source, words in docs:
        held.update((lang, w) for w in set(words))
        n[lang, source].update(words)
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted(w for (x, w), k in held.items() if x == lang and k >= 3)
        groups = sorted(s for x, s in n if x == lang)
        counts = {s: n[lang, s] for s in groups} | {None: sum((n[lang, s] for s in groups), Counter())}
        total = {s: sum(c[w] for w in kept) for s, c in counts.items()}
        share = {s: {w: 1 + 10**9 * (c[w] + 1) // (total[s] + len(kept)) for w in kept} for s, c in counts.items()}

        def f(p, q):
            return (p - q) ** 2 // q

        for s in groups:
            parts = {
                "pair": [(x, sum(f(share[s][w], share[x][w]) for w in kept)) for x in groups if x != s],
                "term": [(w, f(share[s][w], share[None][w])) for w in kept if counts[s][w] and share[s][w] > share[None][w]],
            }
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(items[: top if part == "term" else None], 1)]
    return sorted(out)


SOURCES = "text string, lang string, source string, term string, n long, value long, slice long, block long"


def as_sources(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, 2, 3, 4) for r in rows], SOURCES)


@pytest.mark.parametrize(("group_block", "term_block"), [(1, 1), (2, 5), (32, 4096)])
def test_divergence_in_blocks(spark, group_block, term_block):
    rng = np.random.default_rng(3)
    words = [f"{w}{e}" for w in ("alpha", "Beta", "gamma", "délta", "ZETA", "x") for e in ("", "s", "é", "n")]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 12), p=np.arange(24, 0, -1) / 300)), str(rng.choice(["en", "de"])), f"s{rng.integers(0, 5)}") for _ in range(60)]
    rows += [(None, None, None), ("", "en", "empty"), ("same same", "one", "a"), ("same", "one", None), ("same\x00SAME 7same", "one", "a"), ("alone", "alone", "a"), ("rare", "alone", "b")] + rows[:5]
    got = divergence.source_divergence(as_sources(spark, rows), group_block, term_block, top=3)
    assert sorted(map(tuple, got.collect())) == plain_divergence(rows, top=3)


def test_divergence_of_odd_rows(spark):
    rows = [(t, None, "s") for _, t in TEXTS] + [(t, "x", s) for _, t in TEXTS for s in ("a", "b")]
    assert sorted(map(tuple, divergence.source_divergence(as_sources(spark, rows)).collect())) == plain_divergence(rows)
    assert divergence.source_divergence(empty(spark)).count() == 0


@given(st.lists(st.tuples(st.integers(0, 10**14), st.integers(1, 10**14)), min_size=1, max_size=20))
def test_shares_are_exact(pairs):
    n = np.array([a for a, _ in pairs], np.int64)
    whole = n + np.array([b for _, b in pairs], np.int64)
    assert divergence._shares(n, whole).tolist() == [1 + 10**9 * (int(a) + 1) // int(w) for a, w in zip(n, whole, strict=True)]


def test_shares_of_large_counts(spark):
    rows = [(10**13, 3 * 10**14, 7), (0, 1, 1), (9_300_000_000, 9_300_000_001, 5)]
    df = spark.createDataFrame(rows, "n long, total long, kept long").select(divergence.share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    assert [r.p for r in df.collect()] == [1 + 10**9 * (n + 1) // (t + k) for n, t, k in rows]


# --------------------------------------------------------------------------


def plain_mask(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (
        (len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words)) + 4 * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text))
        + 8 * bool(re.search("[#$%&*|]", text))
    )


def plain_audit(rows, labels):
    first, marks = {}, defaultdict(lambda: [0, 0])
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, good, toxic in labels:
        if i is not None:
            marks[i] = [max(marks[i][0], good or 0), max(marks[i][1], toxic or 0)]
    docs = [(s or "", plain_mask(t or "") + 16 * (i is not None and i > first[t or ""]), marks[i] if i is not None else [0, 0]) for i, t, s in rows]
    out, removed = [], Counter()
    for part in {d[0] for d in docs}:
        own = [(m, *g) for s, m, g in docs if s == part]
        for order in permutations("ABCDE"):
            seen = 0
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [x for x in own if x[0] & bit and not x[0] & seen]
                removed[part, letter] += len(gone)
                out.append((part, "".join(order), step, sum(not x[0] & (seen | bit) for x in own), len(gone), sum(bool(x[0] & bit and x[0] & seen) for x in own),
                            sum(x[0] == bit for x in own), sum(x[1] == 1 for x in gone), sum(x[2] == 1 for x in gone), letter))
                seen |= bit
    return sorted((*row[:-1], removed[row[0], row[-1]]) for row in out)


AUDIT = "doc_id long, text string, source string, mask int, part string, h long, digest string, quality int"


def test_filter_audit(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(int(rng.integers(50, 600)))], 210)) for _ in range(8)]
    texts += ["ALL CAPS HERE", "a # sign", "", "Once " * 300, texts[0] + " |"]
    rows = [(i, texts[int(k)], ["a", "b", None, ""][i % 4]) for i, k in enumerate(rng.integers(0, len(texts), 80))]
    rows += [(None, texts[0], "a"), (None, None, None), (3, texts[0], "c"), (3, texts[0], "c"), (200, None, "a"), (201, "\x85 \xa0" + texts[1], "only")]
    rows += [(1000 + i, t, "odd") for i, t in TEXTS if i is not None]
    labels = [(int(i), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in rng.integers(0, 90, 60)] + [(None, 1, 1), (5, None, None), (6, 0, 0), (6, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "p", 2, "d", 1) for r in rows], AUDIT)
    got = filter_audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, labels)


def test_filter_audit_of_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(empty(spark), labels).count() == 0
    assert filter_audit.filter_audit(documents(spark), labels).count() == 600


@given(st.text(max_size=80))
def test_masks_are_those_of_the_patterns(text):
    text = text.encode("utf-8", "ignore").decode()
    assert filter_audit.own_mask(text.encode()) == plain_mask(text)


def test_sketch_keeps_all_repeats_and_clears_most_others(spark):
    once = spark.range(30_000).select(F.xxhash64("id").alias("h"))
    twice = spark.range(40_000, 42_000).select(F.xxhash64("id").alias("h"))
    hot = spark.range(20_000).select(F.lit(-1).cast("long").alias("h"))
    hashes = once.union(twice).union(twice).union(hot).repartition(7)
    found = filter_audit.possible_repeats(hashes, 54_000)
    got = {r.h for r in found.collect()}
    assert found.count() == len(got)
    assert {r.h for r in twice.collect()} | {-1} <= got
    assert len(got) < 2_001 + 1_500
