"""Classifiers, the similarity join and the pipeline."""

from __future__ import annotations

import dataclasses
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given
from hypothesis import strategies as st
from odd import PLAIN, TEXTS, documents, empty
from pyspark.sql import functions as F
from test_lines_and_windows import lines_kept, plain_words

import corpus_pipeline
from compare import compare
from pkgrisk.llm import jaccard_join, quality, toxicity
from pkgrisk.llm.components import components
from pkgrisk.llm.queries import ORACLES, QUALITY_CUT, QUERIES
from pkgrisk.llm.vocabulary import model_path
from pkgrisk.session import Scratch

FOLDER = "/root/testdata/sf0.001"


def labelled(n=400, seed=3):
    """Clean texts, and texts of which half are shouted or hold a bad word."""
    pick = random.Random(seed)
    words = ["".join(pick.choice("aeioustrnl") for _ in range(pick.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = pick.choices(words, k=pick.randint(5, 120))
        bad = i % 2
        shouted = [w.upper() + "!!" for w in text] if bad else text
        nasty = text[:]
        if bad:
            for _ in range(max(1, len(text) // 20)):
                nasty.insert(pick.randrange(len(nasty)), "grob" + pick.choice(words))
        rows.append((i, " ".join(shouted), " ".join(nasty), bad))
    return rows


def test_quality_learns_and_scores_odd_rows(spark):
    rows = labelled()
    df = spark.createDataFrame([(i, a, b) for i, a, _, b in rows], "doc_id long, text string, y int")
    model = quality.fit(df.filter("doc_id < 300"))
    scored = quality.with_quality(df.filter("doc_id >= 300"), model).collect()
    assert np.mean([(r.quality_score >= 0.5) == bool(r.y) for r in scored]) > 0.97
    odd = quality.with_quality(documents(spark), model).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r.quality_score <= 1 for r in odd)
    assert quality.with_quality(empty(spark), model).count() == 0


def test_every_code_point_of_a_long_token_counts(spark):
    run = "".join(random.Random(6).choice("木林森山川石田") for _ in range(400))
    for at in (0, 70, 399):
        assert quality.grams(run) != quality.grams(run[:at] + "水" + run[at + 1 :])
    assert quality.grams("x" * 90 + "7!") != quality.grams("x" * 90 + "!7")
    assert quality.grams("a1" * 20) != quality.grams("a1" * 10 + "b-" * 10)
    a, b, c = "a" * 20, "b" * 25, "c" * 25
    assert quality.grams(f"{a} {b} {c} {a}") != quality.grams(f"{a} {c} {b} {a}")
    # Words of two scripts without spaces, told apart by what follows the first 64 code points.
    pick = random.Random(8)
    rows = [(i, "木" * 70 + "".join(pick.choice("山川石田" if i % 2 else "水火土金") for _ in range(60)), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = quality.fit(df.filter("doc_id < 160"))
    assert all((model.score(t) >= 0.5) == bool(y) for _, t, y in rows[160:])


def test_quality_of_one_class_or_none(spark):
    df = spark.createDataFrame([(1, "a b c", 1), (2, "d e", 1)], "doc_id long, text string, y int")
    assert quality.fit(df).score("a b") > 0.5
    assert quality.fit(df.limit(0)).score("a b") == 0.5
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (2, None), (99, 0)], "doc_id long, quality int")
    assert [r.y for r in quality.train_rows(documents(spark).limit(2), labels, "quality", F.lit(True)).collect()] == [1]


@given(st.lists(st.one_of(st.sampled_from(["word", "Word", "WORD,", "McX", "ǅx", "A木B", "éa.", "7", "x7", "木", "İi", "ª", "ß!", "Σς"]), st.text(min_size=1, max_size=6)), max_size=6))
def test_plain_shapes_are_shapes(parts):
    for token in "".join(parts).split() + parts:
        assert quality._plain_shape(token) in ("", quality._shape(token))
        assert not (token.islower() and token.isalpha()) or quality._shape(token) == "x"


def test_conflicting_labels(spark):
    labels = spark.createDataFrame([(0, 0, 1), (0, 1, 0), (1, 0, 0), (1, 0, None)], "doc_id long, quality int, toxic int")
    for label, want in (("quality", {0: 1, 1: 0}), ("toxic", {0: 1, 1: 0})):
        rows = quality.train_rows(documents(spark), labels, label, F.lit(True)).collect()
        assert {r.doc_id: r.y for r in rows} == want and len(rows) == 3  # id 1 is there twice


def test_the_fit_does_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(i, a, b) for i, a, _, b in labelled()], "doc_id long, text string, y int")
    small = quality.Settings(fit_rows=120)
    one, two = quality.fit(rows.coalesce(1), small), quality.fit(rows.orderBy(F.xxhash64("text")).repartition(7), small)
    assert one.weights == two.weights and (one.bias, one.slope, one.shift) == (two.bias, two.slope, two.shift)


def test_all_features_of_the_sample_count(spark):
    """A telling n-gram of few documents is a feature however many commoner ones there are, and its counts are those of all rows."""
    rows = [(i, f"c{i % 9} c{i % 7} " + ("rare" if i % 40 == 1 else "other") + f" d{i % 11}", int(i % 40 == 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = quality.fit(df)
    assert model.weights["rare"] == max(model.weights.values()) and model.score("rare") > model.score("other")


def test_coordinate_descent_reaches_the_minimum():
    pick = np.random.default_rng(0)
    found = [np.flatnonzero(pick.random(12) < 0.4) for _ in range(60)]
    y, scale = np.where(pick.random(60) < 0.5, 1, -1), pick.normal(size=12)
    w, b = quality.descend(found, y, scale, quality.Settings(epochs=300))

    def loss(w, b):
        cost = np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum())) * quality.Settings().penalty
        m = np.array([quality._margin(w, b, scale, f) for f in found])
        return 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - y * m) ** 2).sum()

    best = loss(w, b)
    assert all(best <= loss(w + 1e-3 * pick.normal(size=12), b + 1e-3 * pick.normal()) + 1e-9 for _ in range(50))


SMALL = toxicity.Settings(fit_docs=1400, epochs=8)


def test_coordinate_descent_holds_no_values_of_the_sample():
    random = np.random.default_rng(3)
    found = [np.sort(random.choice(5000, 500, replace=False)).astype(np.int32) for _ in range(1000)]
    y, scale = np.where(random.random(1000) > 0.5, 1, -1), random.normal(size=5000)
    tracemalloc.start()
    quality.descend(found, y, scale, quality.Settings(epochs=1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All of them are 4 MB.
    assert peak < 1e6


def test_toxicity_learns_word_starts_and_scores_odd_rows(spark):
    rows = labelled(1600)
    df = spark.createDataFrame([(i, t, b) for i, _, t, b in rows], "doc_id long, text string, y int")
    net = toxicity.fit(df.filter("doc_id < 1400"), SMALL)
    scored = toxicity.with_toxicity(df.filter("doc_id >= 1400"), net).collect()
    assert np.mean([(r.toxicity_score >= 0.5) == bool(r.y) for r in scored]) > 0.9
    odd = toxicity.with_toxicity(documents(spark), net).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r.toxicity_score <= 1 for r in odd)
    assert toxicity.with_toxicity(empty(spark), net).count() == 0
    assert toxicity.fit(df.limit(0), SMALL).slope == 0


def test_network_gradients_and_fast_scores():
    net = toxicity.Network(dataclasses.replace(SMALL, gram_rows=64, word_size=3, gram_size=3, hidden=3, attention=4), [b"aa", b"bb"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["word"][0] = 0
    pick = random.Random(0)
    texts = [[pick.choice([b"aa", b"bb", b"cde", b"xyzuv"]) for _ in range(n)] for n in (3, 40, 70)]
    y = np.array([1.0, 0.0, 1.0])
    grads, _ = toxicity.gradients(net, texts, y)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        own, loss = net.p[name][at], []
        for step in (1e-4, -1e-4):
            net.p[name][at] = own + step
            loss.append(toxicity.gradients(net, texts, y)[1])
        net.p[name][at] = own
        assert abs((loss[0] - loss[1]) / 2e-4 - g[at]) < 1e-3 * max(1, abs(g[at])), name
    words, places, mask, owner = toxicity._frames(texts)
    x = net.inputs(words)[0][places]
    states = np.concatenate([net.states(w, x @ net.p[f"x{w}"] + net.p[f"c{w}"], mask, False)[0] for w in "fb"], 2)
    slow = toxicity.document_logits(net.pool(states, mask)[0], owner, 3)[0]
    fast = toxicity.Scorer(net).logits([b" ".join(t).decode() for t in texts])
    assert np.allclose(slow, fast, atol=1e-4)


def test_windows_cover_whole_texts():
    for n in range(0, 200):
        spans = toxicity.windows_of(n)
        assert {i for a, b in spans for i in range(a, b)} == set(range(n)) and all(b - a <= toxicity.WINDOW for a, b in spans)


def expected_classes(rows):
    sets = defaultdict(list)
    for i, text in rows:
        grams = frozenset(jaccard_join.ngrams(text).tolist())
        if grams:
            sets[grams].append(i)
    keys, links, up = list(sets), Counter(), list(range(len(sets)))
    for a in range(len(keys)):
        for b in range(a):
            shared = len(keys[a] & keys[b])
            if shared >= 0.8 * (len(keys[a]) + len(keys[b]) - shared) - 1e-9:
                links[a] += 1
                links[b] += 1
                old, new = up[a], up[b]
                up = [new if u == old else u for u in up]

    def low(ids):
        known = [i for i in ids if i is not None]
        return min(known) if known else None

    out = Counter()
    for n, grams in enumerate(keys):
        group = [i for m, other in enumerate(keys) if up[m] == up[n] for i in sets[other]]
        for i in sets[grams]:
            out[i, low(group), low(sets[grams]), links[n]] += 1
    for i, text in rows:
        if not len(jaccard_join.ngrams(text)):
            out[i, i, i, 0] += 1
    return out


def test_similar_documents_on_odd_rows_and_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    pick = random.Random(4)
    words = ["".join(pick.choice("abcdefgh") for _ in range(4)) for _ in range(500)]
    base = pick.choices(words, k=150)
    rows = list(TEXTS)
    for i in range(60):  # near copies of one text: some pairs are links, some are not
        text = base[:]
        for _ in range(pick.randint(1, 5)):
            text[pick.randrange(150)] = pick.choice(words)
        rows.append((1000 + i, " ".join(text)))
    rows += [(2000 + i, " ".join(pick.choices(words, k=80))) for i in range(60)] + [(3000 + i, " ".join(base)) for i in range(20)]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, class string, node long")
    got = jaccard_join.similar_documents(df)
    assert Counter(tuple(r) for r in got.select("doc_id", "class_id", "copy_of", "n_links").collect()) == expected_classes(rows)
    assert jaccard_join.similar_documents(empty(spark)).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    table = jaccard_join.least_matches(0.8, 1e-4)
    assert all(b[1] >= a[1] for a, b in zip(table, table[1:])) and table[-1][1] > 100
    pick = np.random.default_rng(1)
    equal = pick.random((4000, jaccard_join.HASHES)) < 0.8
    signatures = np.vstack((np.ones((1, jaccard_join.HASHES), np.uint16), equal.astype(np.uint16)))
    assert len(jaccard_join.survivors(signatures, 0, np.arange(1, 4001), table)) > 3980
    signatures[1:] = pick.random((4000, jaccard_join.HASHES)) < 0.5
    assert len(jaccard_join.survivors(signatures, 0, np.arange(1, 4001), table)) == 0


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 540)] + [(700, 701), (701, 702), (702, 700), (5, 5), (140, 600)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(df, Scratch(spark, "test"), "c").collect()}
    want = {i: 100 for i in [*range(100, 141), 600]} | {i: 500 for i in range(500, 540)} | {i: 700 for i in (700, 701, 702)}
    assert got == want
    assert components(df.limit(0), Scratch(spark, "test"), "c").count() == 0


def test_same_rows_as_sql(spark):
    for name, sql in ORACLES.items():
        assert compare(spark, name, QUERIES[name], sql, FOLDER) is None


def test_every_query_covers_its_table(spark):
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name in ("op4_jaccard_join", "op8_quality_classifier"):
        assert QUERIES[name](spark, FOLDER).count() == n


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[1:]:
        after = stage(spark, docs, FOLDER)
        assert after.count() <= docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == names
    odd = documents(spark)
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, odd, FOLDER).count() > 0
        assert stage(spark, empty(spark), FOLDER).count() == 0


def plain_stages(scores):
    """The stages in plain Python, over rows of the columns of documents; ``scores`` are those of the quality classifier by text."""
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=model_path())
    windows = defaultdict(set)
    for r in pq.read_table(f"{FOLDER}/benchmark.parquet").to_pylist():
        words = plain_words(r["text"])
        for i in range(max(1, len(words) - 9) if words else 0):
            windows[len(words[i : i + 10])].add(tuple(words[i : i + 10]))

    def lines(rows):
        out = []
        for (i, text, lang, source, _), (_, kept, _, dropped) in zip(rows, lines_kept([r[:2] for r in rows]), strict=True):
            if not dropped or kept:
                text = kept if dropped else text
                out.append((i, text, lang, source, None if text is None else len(text)))
        return out

    def near(rows):
        first = {i for i, low, *_ in expected_classes([r[:2] for r in rows]) if i == low}
        return list({r[:2]: r for r in rows if r[0] in first}.values())

    def clean(rows):
        def hit(text):
            words = plain_words(text)
            return any(tuple(words[i : i + n]) in known for n, known in windows.items() for i in range(len(words) - n + 1))

        bad = {r[0] for r in rows if hit(r[1])}
        return [r for r in rows if r[0] not in bad]

    def pieces(rows):
        return [(*r, tuple(library.encode(r[1] or "")), len(library.encode(r[1] or ""))) for r in rows]

    return [lambda rows: [r for r in rows if scores[r[1]] >= QUALITY_CUT], lines, near, clean, pieces]


def test_pipeline_rows_are_those_of_plain_python(spark):
    def rows_of(df):
        return Counter(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect())

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality.fit(quality.train_rows(docs, labels, "quality", F.expr("crc32(cast(doc_id as string)) % 5 <> 0")))
    rows = [tuple(r) for r in docs.collect()]
    plain = plain_stages({r[1]: model.score(r[1]) for r in rows})
    want = plain[0](rows)
    assert 0 < len(want) < len(rows)
    assert rows_of(corpus_pipeline.STAGES[0][1](spark, docs, FOLDER)) == Counter(want)
    for stage in plain[1:]:
        want = stage(want)
    assert rows_of(corpus_pipeline.run(spark, FOLDER)) == Counter(want)
    # Every later stage alone, over rows that it drops: copies, a benchmark item, a text of repeated lines only.
    item = pq.read_table(f"{FOLDER}/benchmark.parquet").to_pylist()[0]["text"]
    odd = [*TEXTS, (20, f"before {item} after"), (21, PLAIN.split("\n")[0])]
    rows = [(None if i is None else i + 10**9, t, None, "s", None) for i, t in odd] + rows[:60]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for (name, stage), own in list(zip(corpus_pipeline.STAGES, plain, strict=True))[1:]:
        want = own(rows)
        assert name == corpus_pipeline.STAGES[-1][0] or len(want) < len(rows), name
        assert rows_of(stage(spark, df, FOLDER)) == Counter(want), name
