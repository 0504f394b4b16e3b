"""Tokens, pieces, pages and fingerprints against the libraries, plain Python and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from odd import TEXTS, documents, empty
from pyspark.sql import functions as F

from pkgrisk.llm import fingerprint, html_text, piece_lattice, token_count
from pkgrisk.llm.vocabulary import SPACE, model_path

SIGNS = list("  aabtheing\n▁.é１😀́　\t\r'1tionAB”")


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=model_path())


def random_texts(n, size=50, seed=5):
    pick = random.Random(seed)
    return ["".join(pick.choice(SIGNS) for _ in range(pick.randint(0, size))) for _ in range(n)]


def test_counts_are_the_librarys(library):
    own = token_count.PieceCounter(model_path())
    for text in random_texts(3000) + [t or "" for _, t in TEXTS] + ["▁" * 50 + "a" * 2000]:
        assert own.text(text) == len(library.encode(text))


def test_counts_on_odd_rows(spark, library):
    got = token_count.with_token_counts(documents(spark), model_path(), 4096)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == Counter(
        (i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t in TEXTS
    )
    assert token_count.with_token_counts(empty(spark), model_path(), 4096).count() == 0


def test_cache_generations_change_no_count(monkeypatch):
    monkeypatch.setattr(token_count, "CACHE_WORDS", 3)
    small, texts = token_count.PieceCounter(model_path()), random_texts(200)
    assert [small.text(t) for t in texts] == [token_count.PieceCounter(model_path()).text(t) for t in texts]


@pytest.mark.parametrize("frequent", [0, 40, 200_000])
def test_pieces_are_the_librarys_and_come_back(spark, library, frequent):
    texts = [(i, t) for i, t in enumerate(random_texts(400, seed=frequent))] + TEXTS + [(1000, SPACE * 70 + "the" * 100)]
    df = spark.createDataFrame([(i, t, "k") for i, t in texts], "doc_id long, text string, key string")
    got = piece_lattice.encode(df, model_path(), frequent=frequent).withColumn("back", piece_lattice.decode(F.col("ids"), model_path()))
    rows = got.collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == Counter((i, tuple(library.encode(t or ""))) for i, t in texts)
    assert all(r.back == (r.text or "").replace(SPACE, " ") for r in rows)


def test_pieces_of_odd_tables(spark):
    got = piece_lattice.encode(documents(spark), model_path())
    assert got.columns.count("ids") == 1 and got.count() == len(TEXTS)
    assert piece_lattice.encode(empty(spark), model_path()).count() == 0


def test_frequent_words_come_in_one_job(spark, library, monkeypatch):
    df = spark.createDataFrame([(0, "the rare thing"), (1, "the the"), (2, None)], "doc_id long, text string")
    # An iterator runs a job for each partition.
    monkeypatch.setattr(type(df), "toLocalIterator", None)
    rows = {r.doc_id: list(r.ids) for r in piece_lattice.encode(df, model_path(), frequent=2).collect()}
    assert rows == {0: library.encode("the rare thing"), 1: library.encode("the the"), 2: []}


def test_pairs_of_rare_words_move_to_words_and_texts_only(spark, library):
    texts = [(i, f"the rare{i % 3} thing thing{i % 3}") for i in range(9)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = piece_lattice.encode(df, model_path(), frequent=2)
    # Copies of a text are not brought together in a shuffle of their own.
    assert not re.search(r"Exchange hashpartitioning\(__row#\w+, key#", got._jdf.queryExecution().executedPlan().toString())
    assert {r.doc_id: list(r.ids) for r in got.collect()} == {i: library.encode(t) for i, t in texts}


def test_flanks_are_numbers(spark):
    parts = [(3, 0, 5), (16, 7, piece_lattice.LAST), (1, 0, 1)]
    df = spark.createDataFrame([(piece_lattice.flank(*p),) for p in parts], "part long")
    assert [tuple(r) for r in df.select(*piece_lattice.flank_fields(F.col("part"))).collect()] == parts
    table = piece_lattice.piece_table(spark, model_path())
    assert dict(table.dtypes)["left"] == dict(table.dtypes)["right"] == "array<bigint>"


def test_decode_of_odd_ids(spark, library):
    rows = [(0, None), (1, []), (2, [1, 264, 2]), (3, library.encode("  é\U0001f600")), (4, [3 + 0xFF])]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i int, ids array<int>").select("i", piece_lattice.decode(F.col("ids"), model_path()).alias("t")).collect()}
    assert got == {0: None, 1: "", 2: "a", 3: "  é\U0001f600", 4: "�"}


PAGE = (
    "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='box'>Site box</div>"
    "<article><header><h1>Head &amp; line</h1></header><p>One <b>bold\n text<br>more<p>Two</p><div class='share'>Share</div>"
    "<div class='hint'>Site hint</div><p>Common passage</p></article><section class='comments'><p>Nice!</p></section>"
    "<form>mail</form><script>x='<p>no</p>'</script><footer>End</footer></body></html>"
)


def test_page_without_template():
    assert html_text.main_text(PAGE) == "Head & line\nOne bold text more\nTwo\nSite hint\nCommon passage"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("plain &lt;text&gt;\n two") == "plain <text> two"
    assert html_text.main_text("<div>" * 3000 + "deep" + "</div>" * 2999) == "deep"
    assert html_text.main_text("<p>open<p>cut &am") == "open\ncut &am"


def test_recurring_subtrees_go_and_common_passages_stay(spark):
    def page(n):
        return PAGE.replace("Two", f"Two {n}")

    other = "<body><div class='box'>Site box</div><p>Body %d</p></body>"
    rows = [(n, f"http://a.example/{n}", page(n)) for n in range(8)] + [(100 + n, f"https://b.example/{n}", other % n) for n in range(3)]
    rows += [(200, None, page(1)), (201, "not a url", None), (202, "http://a.example/0", page(0)), (None, "http://c.example", "")]
    df = spark.createDataFrame([(*r, "t", "h", 1) for r in rows], "page_id long, url string, html string, text string, host string, subtree long")
    got = html_text.extract_text(df, min_pages=5)
    assert got.columns.count("text") == 1
    text = {r.page_id: r.text for r in got.collect()}
    assert got.count() == len(rows)
    assert text[3] == "Head & line\nOne bold text more\nTwo 3\nCommon passage"
    assert text[200] == "Head & line\nOne bold text more\nTwo 1\nSite hint\nCommon passage"
    assert text[101] == "Site box\nBody 1" and text[201] == text[None] == ""
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_names_drop_no_main_text():
    for page in (
        "<div class='content no-sidebar'><article><p>Text</p></article></div>",
        "<div id='page' class='has-sidebar'><div class=widget>Login</div><article><p>Text</p></article></div>",
        "<div id='search'><main><p>Text</p></main></div>",
        "<article class='post comments-open'><p>Text</p></article>",
        "<article><section id='related-work'><p>Text</p></section><div class='share'>Share</div></article>",
        "<article><h2 id='search'>Text</h2><ul class='x menu'><li>Home</li></ul></article>",
        "<main><div class='login-notice'>Text</div><div class='post share'>Share</div></main>",
        "<div id='page' class='has-sidebar'><p id='notice'>Text</p></div><div class='cookie-banner'>OK</div>",
        "<article><pre><span class='comment'>Text</span></pre><div><span class='share'>Share</span></div></article>",
        "<x-page class='page-widget'>Menu<article><p>Text</p></article></x-page>",
    ):
        assert html_text.main_text(page) == "Text", page
    nested = "<article><p>A</p><div class='related'>B<article>C</article></div></article><div class=comments>D</div>"
    assert html_text.main_text(nested) == "A"


def test_pages_that_leave_tags_out_or_wrap_themselves():
    for page in (
        "<html><head><title>t</title><body><article><p>Text</p></article>",
        "<html><head><title>t</title><meta charset=utf-8><div><p>Text</p></div>",
        "<form id=f><input><label>Name</label><div><article><p>Text</p></article></div></form>",
        "<form><main><p>Text</p><button>Go</button></main></form>",
        "<nav><a href='/'>Home</a><article><p>Text</p></article>",
        "<div class='related-work'><p>Text</p></div>",
        "<section class='share-prices'>Text</section><div class='menu'>Home</div>",
        "<div id='login-guide'><div class='share-x'>Text</div></div><footer>End</footer>",
    ):
        assert html_text.main_text(page) == "Text", page
    order = "<div class='share-prices'>A<div class='login-guide'>B</div>C</div>"
    assert html_text.main_text(order) == "A\nB\nC"


def test_articles_of_readers_go():
    for comments in (
        "<div id='comments'><article class='comment-body'>nice</article></div>", "<section class='x comments'><article>nice</article></section>",
        "<article class='comment'>nice</article>", "<div class='related-posts'><article><p>nice</p></article></div>",
    ):
        assert html_text.main_text(f"<article><p>Text</p></article>{comments}") == "Text", comments
        # In a main element a part of a longer name marks nothing.
        assert html_text.main_text(f"<main><p>Text</p>{comments}</main>") == ("nice" if "related-posts" in comments else "Text"), comments
        assert html_text.main_text(f"<article><p>Text</p>{comments.replace('related-posts', 'related')}</article>") == "Text" or "class='comment'" in comments
    # Without another article the marked one is the main text.
    assert html_text.main_text("<div class='widget'><article>Text</article></div>") == "Text"
    assert html_text.main_text("<div class='page-widget'><main><h1>Text</h1></main></div>") == "Text"


def test_deep_and_unmatched_tags_take_linear_time():
    for page in ("<div>" * 20_000 + "Text" + "</section></b>" * 20_000, "<span>" * 20_000 + "<div></div>" * 20_000 + "Text"):
        began = time.process_time()
        assert html_text.main_text(page) == "Text"
        assert time.process_time() - began < 10


def test_the_main_text_is_no_template(spark):
    """Copies of a page, wrappers of articles and passages that articles share stay; paragraphs of a template go."""
    shared = "<ul><li>Shared item</li></ul><div>Shared passage</div><div class='w'><p>Shared words</p></div>"
    kinds = {
        "main": lambda n: "<main><article><p>Same</p></article></main>",
        "div": lambda n: "<div class=content><article><p>Same</p></article></div>",
        "only": lambda n: "<div><main><ul><li>Same</li></ul></main></div>",
        "body": lambda n: "<div class=content><p>Same</p></div>",
        "list": lambda n: f"<article><p>Own {n}</p>{shared}</article>",
        "items": lambda n: f"<main><div class=c><div class=d>Common</div>Own {n}</div></main>",
        "foot": lambda n: f"<p>Own {n}</p><p>All rights</p><table><tr><td>Imprint</td></tr></table>",
    }
    rows = [(f"http://{k}.example/{n}", f"<body>{page(n)}</body>") for k, page in kinds.items() for n in range(10)]
    got = {r.url: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "url string, html string")).collect()}
    same = {got[f"http://{k}.example/{n}"] for k in ("main", "div", "only", "body") for n in range(10)}
    assert same == {"Same"}
    for n in range(10):
        assert got[f"http://list.example/{n}"] == f"Own {n}\nShared item\nShared passage\nShared words"
        assert got[f"http://items.example/{n}"] == f"Common\nOwn {n}"
        assert got[f"http://foot.example/{n}"] == f"Own {n}"


def test_part_of_the_articles_makes_no_template(spark):
    rows = [(f"http://a.example/{n}", f"<article><p>Own {n}</p>{'<div class=x>Some</div>' if n < 9 else ''}</article>") for n in range(10)]
    got = html_text.extract_text(spark.createDataFrame(rows, "url string, html string"))
    assert sum("Some" in r.text for r in got.collect()) == 9


def entropy_one_by_one(data):
    out = []
    for i in range(len(data) - 63):
        total = sum(int(fingerprint._TERMS[c]) for c in Counter(data[i : i + 64].tolist()).values())
        out.append((fingerprint._MOST - total) * 1000 // fingerprint._MOST)
    return out


def test_entropy_is_that_of_each_window():
    pick = np.random.default_rng(0)
    for n in (0, 63, 64, 65, 300):
        for k in (1, 2, 20, 200):
            data = pick.integers(0, k, n).astype(np.uint8)
            assert fingerprint.entropy_levels(data).tolist() == entropy_one_by_one(data)


def test_selected_windows_are_the_rarest_of_their_neighbourhoods():
    pick = np.random.default_rng(1)
    for n in (1, 5, 64, 65, 400):
        ranks = pick.integers(1, 40, n)
        reach, points = min(64, n), np.zeros(n, int)
        for i in range(n - reach + 1):
            points[i + int(np.argmin(ranks[i : i + reach]))] += 1
        assert fingerprint.select(ranks).tolist() == np.flatnonzero(points >= min(fingerprint.POINTS, points.max())).tolist()


def test_digests_with_the_next_document(spark):
    df = documents(spark)
    rank = fingerprint.corpus_rarity(df)
    rows = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = Counter()
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        t, u = t or "", u or ""
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
        data = np.frombuffer(edited.encode(), np.uint8)
        whole = fingerprint.digest(data, rank[fingerprint.entropy_levels(data)])
        assert (fingerprint._edited(fingerprint._Text(i, t, rank), fingerprint._Text(0, u, rank), rank)[1] == whole).all()
    for parts in (1, 3, 8):
        got = fingerprint.compare_with_next(df, rank, parts).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    own = {(r.doc_id, r.fingerprint) for r in fingerprint.fingerprints(df, rank).collect()}
    assert own == {(r.doc_id, r.fingerprint) for r in got}
    assert fingerprint.compare_with_next(empty(spark), rank).count() == 0
    one = fingerprint.compare_with_next(df.filter("doc_id = 0"), rank).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_likeness_tells_halves_from_strangers():
    pick = random.Random(2)
    words = ["".join(pick.choice("abcdefghijklmnop") for _ in range(pick.randint(2, 9))) for _ in range(4000)]

    def text():
        return np.frombuffer(" ".join(pick.choices(words, k=500)).encode(), np.uint8)

    rank = fingerprint.rarity(np.bincount(fingerprint.entropy_levels(text()), minlength=1001))
    a, b = text(), text()

    def made(x):
        return fingerprint.digest(x, rank[fingerprint.entropy_levels(x)])

    assert fingerprint.likeness(made(a), made(a)) == 1.0
    assert fingerprint.likeness(made(a), made(np.concatenate((a[: len(a) // 2], b[: len(b) // 2])))) > 0.3
    assert fingerprint.likeness(made(a), made(b)) < 0.2
