"""Line dedup, decontamination and license scan against plain Python and on odd rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import TEXTS, documents, empty

from pkgrisk.llm import decontaminate, license_scan, line_dedup
from pkgrisk.llm.text import words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@given(st.text(max_size=60))
def test_words_are_those_of_the_pattern(text):
    text = text.encode("utf-8", "ignore").decode()
    assert [w.decode() for w in words_of(text)] == plain_words(text)


def lines_kept(rows):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            k = key(line)
            if len(k) >= 10:
                order = (i is not None, i or 0)
                first[k] = min(first.get(k, order), order)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == (i is not None, i or 0)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_line_dedup_on_odd_rows(spark, batches):
    kept = line_dedup.dedup_lines(documents(spark), batches=batches)
    assert Counter((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in kept.collect()) == Counter(lines_kept(TEXTS))
    assert {"key", "node", "class"} <= set(kept.columns)


def test_line_dedup_in_batches_with_a_hot_line(spark):
    hot = "this very common line stands in many documents"
    rows = [(i, f"{hot}\nown line number {i // 2}\n{hot.upper()}  \nshort") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.kept_text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df, batches=5).collect()}
    assert got == {i: tuple(rest) for i, *rest in lines_kept(rows)}


def test_runs_are_merged(spark):
    runs = line_dedup.LineRuns(spark, buckets=4, fanout=2)
    for n in range(5):
        keys = spark.range(n * 10, n * 10 + 20).selectExpr("cast(cast(id as string) as binary) as key")
        runs.add(runs.unseen(keys))
    assert len(runs.runs) == 2
    assert runs.seen().count() == runs.seen().distinct().count() == 60
    runs.close()


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def hits(text, windows):
    words, hit, items = plain_words(text), set(), set()
    for window, ids in windows.items():
        n = len(window)
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) == window:
                hit.update(range(i, i + n))
                items |= ids
    return len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


def plain_windows(items):
    out = defaultdict(set)
    for i, text in items:
        w = plain_words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            out[tuple(w[k : k + 10])].add(str(i))
    return out


ITEMS = [
    (1, "brown fox jumps over the lazy dog while seven wizards quietly mix potions today"), (2, "A second LINE"), (3, None), (4, ""), (5, "!!!"),
    (6, "w1 and w2 and w3 and w4 and w5 and w6 and"), (7, "A second LINE"), (11, "éTé 一二三"), (12, "potions"),
]


@pytest.mark.parametrize("block", [200_000, 3])
def test_decontamination_on_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "WINDOWS_PER_BLOCK", block)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark).filter("doc_id <> 8 or text not like 'same%'").filter("doc_id is not null").dropDuplicates(["doc_id"])
    report = decontaminate.hit_report(decontaminate.benchmark_hits(docs, items))
    windows = plain_windows(ITEMS)
    got = {r.doc_id: tuple(r)[1:] for r in report.collect()}
    assert got == {r.doc_id: hits(r.text, windows) for r in docs.collect()}


@pytest.mark.parametrize("block", [200_000, 5, 2])
def test_blocks_keep_rows_of_equal_ids(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "WINDOWS_PER_BLOCK", block)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    report = decontaminate.hit_report(decontaminate.benchmark_hits(documents(spark), items))
    windows = plain_windows(ITEMS)
    assert Counter(map(tuple, report.collect())) == Counter((i, *hits(t, windows)) for i, t in TEXTS)


def test_decontamination_keeps_repeated_rows_and_takes_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.benchmark_hits(documents(spark), items).count() == len(TEXTS)
    assert decontaminate.benchmark_hits(empty(spark), items).count() == 0
    none = decontaminate.hit_report(decontaminate.benchmark_hits(documents(spark), items.limit(0)))
    assert none.filter("contaminated").count() == 0 and none.count() == len(TEXTS)


@settings(max_examples=200)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=3, max_size=3), max_size=5), st.lists(st.sampled_from("abcd"), max_size=40))
def test_search_finds_what_comparing_everywhere_finds(windows, text):
    words = [t.encode() for t in text]
    search = decontaminate.WuManber(3, {tuple(x.encode() for x in w): ["i"] for w in windows})
    want = [i for i in range(len(text) - 2) if text[i : i + 3] in windows]
    assert [i for i, _ in search.occurrences(words)] == want


def test_license_scan_on_odd_rows(spark):
    extra = [(20, "MIT license and the Apache License, under the GENERAL public license; general public\nlicense"), (21, "mit-license license")]
    docs = documents(spark).select("doc_id", "text", "key", "row", "label").unionByName(spark.createDataFrame([(i, t, "k", "r", "l") for i, t in extra], "doc_id long, text string, key string, row string, label string"))
    rows = license_scan.license_report(license_scan.license_spans(docs)).collect()
    assert len(rows) == len(TEXTS) + len(extra)
    assert Counter((r.doc_id, r.n_words) for r in rows) == Counter((i, len(plain_words(t))) for i, t in TEXTS + extra)
    by_id = {r.doc_id: r for r in rows}
    assert tuple(by_id[20])[2:6] == (4, 0, 11, "apache,gpl,mit") and by_id[20].score == 1.0
    assert by_id[21].n_base == 1 and by_id[21].first_word == by_id[21].last_word == 0
    assert by_id[2].n_base == 0 and by_id[2].first_word is None and by_id[2].labels == "" and by_id[2].score == 0.0
    assert license_scan.license_spans(empty(spark)).count() == 0


def test_half_a_notice_twice_is_no_notice(spark):
    half = "licensed under cc by "
    texts = [half * 2, half * 5, half + "nc 4 0", half + half + "nc 4.0", "licensed under cc by other words nc 4.0", "nc 4.0 licensed under cc by"]
    rows = license_scan.license_report(license_scan.license_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    got = {r.doc_id: (r.labels, round(r.score, 2)) for r in rows}
    assert got == {0: ("", 0.5), 1: ("", 0.5), 2: ("cc-by-nc", 1.0), 3: ("cc-by-nc", 1.0), 4: ("", 0.5), 5: ("", 0.5)}


def test_license_notice_with_words_put_in_and_left_out(spark):
    notice = dict(license_scan.NOTICES)["mit-grant"].split()
    changed = notice[:10] + ["quite"] + notice[10:25] + notice[26:]
    text = "before it " + " ".join(changed) + " and after"
    spans = license_scan.license_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).filter("label = 'mit-grant'").collect()
    assert len(spans) == 1
    assert (spans[0].start, spans[0].end) == (2, 2 + len(changed)) and 0.9 < spans[0].coverage < 1
