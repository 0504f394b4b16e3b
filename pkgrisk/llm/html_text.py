"""Main text of web pages, with the template of each site removed.

Every container, paragraph and table outside the main text is hashed with all that it holds.  Spark counts, for each host, on how
many pages of different main text a subtree recurs; subtrees that recur on many of them are its template and are cut out.  What a page
marks as furniture by its element, class or role (menus, footers, scripts, forms, comments, adverts ...) goes even where it does not
recur, since most hosts of a crawl have few pages.

The main text is that of the articles, or else of the main element.  What holds it is never cut as template, and of what lies in it
only one thing is: a container with a class, id or role and nothing but inline text, which every article of the host holds.

Classes and ids mark containers, and inline elements outside running text.  Inside an article or main element the whole class or id has
to be a word for furniture, elsewhere a part of it.  Articles in a marked container (or marked themselves) are comments or teasers if the
page has another article or text in its main element, and else the main text.  Containers of the body that only a part of a longer
name marks ("share-prices") are the main text where nothing else is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgrisk.session import Scratch

MIN_PAGES = 5
MIN_SHARE = 0.001

# Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "head title script style noscript template nav footer aside form button select option textarea label iframe svg math canvas "
    "object audio video dialog menu map".split()
)
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table thead tbody tfoot tr td th caption dl dt dd figure figcaption hr address".split())
CONTAINERS = frozenset("div section header footer nav aside form ul ol li main fieldset details summary center".split())
LISTS = frozenset("ul ol li".split())
HASHED = CONTAINERS | {"p", "table"}
BLOCKS = RUNNING | CONTAINERS | {"article", "body", "html", "head"}
# A start tag of a block ends an open paragraph; these end an open element of their own kind as well.
ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol table dl article section div body main".split())
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "newsletter subscribe subscription sidebar menu navbar nav navigation breadcrumb breadcrumbs footer masthead topbar toolbar "
    "comment comments commentlist reply replies respond disqus share sharing social related recommended popup modal overlay login "
    "signup search searchform pagination pager widget".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAME = re.compile(r"[^a-z0-9]+")
# What may stand in a head; any other element ends it, whether it is closed or not.
IN_HEAD = frozenset("head html title script style noscript template base link meta".split())
# Elements that go without what they hold, but for articles and main elements: a form may wrap the page, a menu may not be closed.
PASSED = frozenset({"form", "nav"})
# Names with one of these tell a state ("no-sidebar", "comments-open"), not what the element is.
STATES = frozenset("no not non without has have with open closed".split())


class _Element:
    """An open element."""

    __slots__ = ("tag", "own", "skipped", "part", "at", "named", "holds", "plain", "running", "marked", "boxed", "spare_at")

    def __init__(self, tag: str, own, skipped: bool | str, part: str, at: int, named: bool = False, holds: bool = False, running: bool = False, marked: bool | str = False, boxed: bool = False, spare_at: int = 0):
        self.tag = tag
        self.own = own  # hash or None
        self.skipped = skipped  # "name": goes without what it holds, but for articles and main elements
        self.part = part  # of the page
        self.at = at  # block count when it opened
        self.named = named  # has a class, id or role
        self.holds = holds  # is or holds an article or main element
        self.plain = True  # holds inline elements only
        self.running = running  # is or lies in running text
        self.marked = marked  # its class or id says that it is furniture; "part": a part of it does
        self.boxed = boxed  # is or lies in a marked container
        self.spare_at = spare_at  # count of spare blocks when it opened


class PageReader(HTMLParser):
    """Reads one page: ``hashes`` of its subtrees and the blocks of its main text.

    Hashes of subtrees inside an article are odd, others even.  Subtrees whose hash is in ``template`` are cut out.
    """

    def __init__(self, template: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self._template = template
        self.hashes: list[int] = []
        self._in_main: list[int] = []
        self._open = [_Element("", blake2b(digest_size=8), False, "body", 0)]
        self._hashing = [self._open[0].own]
        self._blocks: list[tuple[str, str, int]] = []
        self._spare: list[tuple[str, str, int]] = []
        self._count = 0
        self._tags: Counter[str] = Counter()
        self._words: list[str] = []
        self._seen = {"body"}

    def read(self, html: str) -> PageReader:
        self.feed(html)
        self.close()
        while len(self._open) > 1:
            self._pop()
        self._break()
        if self.part == "article":
            # With an article, what else is in the main element is not main text.
            self.hashes += self._in_main
        return self

    @property
    def _main(self) -> str:
        """Where the main text is."""
        if "article" in self._seen:
            return "article"
        if "main" in self._seen and ("boxed" not in self._seen or any(where == "main" for where, _, _ in self._blocks)):
            return "main"
        return "boxed" if "boxed" in self._seen else "body"

    @property
    def part(self) -> str:
        return "article" if self._main == "boxed" else self._main

    @property
    def text(self) -> str:
        """Blocks of the articles, or else of the main element, or else of the body."""
        main = self._main
        blocks = [block for where, block, _ in self._blocks if where == main]
        if main == "body" and not blocks:
            blocks = [block for _, block, _ in sorted(self._spare, key=lambda b: b[2])]
        return "\n".join(blocks)

    def _break(self) -> None:
        block = " ".join("".join(self._words).split())
        self._words = []
        if block:
            self._blocks.append((self._open[-1].part, block, self._count))
            self._count += 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in IN_HEAD and self._tags["head"] and (self._open[-1].tag == "head" or tag == "body"):
            while self._tags["head"]:
                self._pop()
        if tag in BLOCKS:
            self._break()
            self._end_implied(tag)
        elif tag == "br":
            self._words.append(" ")
        if tag in VOID:
            return
        above = self._open[-1]
        part, running = above.part, tag in RUNNING if tag in BLOCKS else above.running
        marked = tag != "article" and not running and self._is_marked(attrs, part)
        # An article or main element in an inline element that goes by its name is read all the same.
        inherited = above.skipped != "name" or tag not in ("article", "main")
        skipped = inherited and above.skipped or self._is_furniture(tag, attrs, part)
        if marked and tag not in BLOCKS:
            # Inline elements go at once, containers when it is known whether they hold an article.
            skipped, marked = skipped or "name", False
        holds = not skipped and tag in ("article", "main")
        boxed = tag != "main" and (above.boxed or bool(marked) or tag == "article" and bool(self._is_marked(attrs, "body")))
        if holds and part not in ("article", "boxed"):
            part = "boxed" if boxed and tag == "article" else tag
            self._seen.add(part)
        own, names = None, [(k, v) for k, v in attrs if k in ("class", "id", "role")]
        if tag in CONTAINERS or tag in HASHED and part == "body":
            own = blake2b(digest_size=8)
            self._hashing.append(own)
            own.update(repr((tag, sorted(names))).encode("utf-8", "surrogatepass"))
        marked = tag in CONTAINERS and tag != "main" and marked
        self._tags[tag] += 1
        self._open.append(
            _Element(tag, own, skipped, part, len(self._blocks), any(v for _, v in names), holds, running, marked, boxed, len(self._spare))
        )

    def _is_furniture(self, tag: str, attrs: list[tuple[str, str | None]], part: str) -> bool | str:
        if tag in PASSED:
            return "name"
        if tag in SKIPPED or tag == "header" and part == "body":
            return True
        if tag in ("html", "body", "main"):
            return False
        return any(key == "role" and value and value.lower() in ROLES or key == "hidden" for key, value in attrs)

    @staticmethod
    def _is_marked(attrs: list[tuple[str, str | None]], part: str) -> bool | str:
        """Whether a class or id is a word for furniture; "part" if only parts of longer names are."""
        marked: bool | str = False
        for key, value in attrs:
            if value and key in ("class", "id"):
                for name in value.lower().split():
                    words = {name} if part != "body" else set(_NAME.split(name))
                    if not FURNITURE.isdisjoint(words) and STATES.isdisjoint(words):
                        if words <= FURNITURE:
                            return True
                        marked = "part"
        return marked

    def _end_implied(self, tag: str) -> None:
        # An open paragraph, with inline elements left open in it, ends where a block starts.
        if not self._tags["p"] and not any(self._tags[name] for name in ENDS_ITSELF.get(tag, ())):
            return
        for i in range(len(self._open) - 1, 0, -1):
            name = self._open[i].tag
            if name == "p" or name in ENDS_ITSELF.get(tag, ()):
                while len(self._open) > i:
                    self._pop()
                if name == tag or name == "p":
                    return
            elif name in SCOPES or name in BLOCKS:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._break()
        if not self._tags[tag]:
            return
        for i in range(len(self._open) - 1, 0, -1):
            name = self._open[i].tag
            if name == tag:
                while len(self._open) > i:
                    self._pop()
                return
            # An inline element's end tag does not close a block around it.
            if tag not in BLOCKS and name in BLOCKS:
                return

    def _pop(self) -> None:
        e = self._open[-1]
        if e.tag in BLOCKS:
            self._break()
        self._open.pop()
        self._tags[e.tag] -= 1
        above = self._open[-1]
        above.holds = above.holds or e.holds
        above.plain = above.plain and e.plain and e.tag not in BLOCKS
        if e.marked and (not e.holds or e.part == "article"):
            if e.marked == "part" and e.part == "body":
                self._spare += self._blocks[e.at :]
            del self._blocks[e.at :]
        if e.own is None:
            return
        digest = self._hashing.pop().digest()
        self._hashing[-1].update(b"E" + digest)
        n = int.from_bytes(digest, "big", signed=True) & ~1
        if e.part in ("article", "boxed"):
            n |= 1
            if e.skipped or not e.plain or not e.named or e.tag in LISTS:
                return
        elif e.holds:
            return
        (self._in_main if e.part == "main" else self.hashes).append(n)
        if n in self._template and e.part != "main":
            del self._blocks[e.at :]
            del self._spare[e.spare_at :]

    def handle_data(self, data: str) -> None:
        if not self._open[-1].skipped:
            self._words.append(data)
        self._hashing[-1].update(b"T" + data.encode("utf-8", "surrogatepass"))


def page_parts(html: str | None) -> dict:
    """Hashes of the subtrees of a page, hash of its main text, and the part of the page which that is."""
    page = PageReader().read(html or "")
    main = blake2b(page.text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return {"subtrees": sorted(set(page.hashes)), "main": int.from_bytes(main, "big", signed=True), "part": page.part}


def main_text(html: str | None, template: frozenset[int] = frozenset()) -> str:
    return PageReader(template).read(html or "").text


def _parts_udf():
    kind = pa.struct([("subtrees", pa.list_(pa.int64())), ("main", pa.int64()), ("part", pa.string())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([page_parts(x.as_py()) for x in batch], kind)

    return F.arrow_udf(run, "struct<subtrees:array<long>,main:long,part:string>")


def _text_udf():
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for html, template in batches:
            yield pa.array([main_text(h.as_py(), frozenset(t.as_py() or ())) for h, t in zip(html, template, strict=True)], pa.string())

    return F.arrow_udf(run, "string")


def host(url: str = "url") -> F.Column:
    return F.lower(F.coalesce(F.try_parse_url(F.col(url), F.lit("HOST")), F.lit("")))


def site_templates(parts: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``host, subtree``: those on at least ``min_pages`` pages and ``min_share`` of the pages of their host.

    ``parts`` has ``host`` and the fields of ``page_parts``.  Pages of the same main text count once; a subtree inside an article has
    to be on all pages with an article.
    """
    pages = parts.groupBy("host").agg(
        F.count_distinct("main").alias("pages"), F.count_distinct(F.when(F.col("part") == "article", F.col("main"))).alias("articles")
    )
    each = parts.select("host", "main", F.explode("subtrees").alias("subtree")).distinct()
    recurring = each.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    least = F.when(F.col("subtree").bitwiseAND(F.lit(1)) == 1, F.col("articles")).otherwise(min_share * F.col("pages"))
    return recurring.join(pages, "host").filter(F.col("n") >= least).select("host", "subtree")


def extract_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """All columns of ``pages`` (with ``url``, ``html``) and ``text``.

    White space in a block is one space, blocks stand in page order, one a line.  Null and empty pages have an empty text.  Pages
    without a usable url share the host ''.  Pages of a host with the same main text count as one for the template.
    """
    names = pages.columns
    keyed = pages.withColumn("__page", F.xxhash64("url", "html"))
    parts = keyed.select(F.col("__page").alias("page"), host().alias("host"), _parts_udf()(F.coalesce("html", F.lit(""))).alias("parts"))
    scratch = Scratch(pages.sparkSession, "subtrees")
    parts = scratch.save(parts, "pages").select("page", "host", "parts.*")
    # What can be cut: within articles, or else, without a main element, in the body.  The result is written so that Spark knows its size
    # and moves the pages only for a large one.
    inside = F.col("subtree").bitwiseAND(F.lit(1)) == 1
    cut = (
        parts.filter("part <> 'main'").select("page", "host", "part", F.explode("subtrees").alias("subtree"))
        .filter(inside == (F.col("part") == "article")).drop("part")
        .join(site_templates(parts, min_pages, min_share), ["host", "subtree"], "left_semi")
        .groupBy("page").agg(F.collect_set("subtree").alias("__template")).withColumnRenamed("page", "__page")
    )
    cut = scratch.save(cut, "cut")
    text = _text_udf()(F.coalesce("html", F.lit("")), F.col("__template"))
    return keyed.join(cut, "__page", "left").select(*[F.col(f"`{n}`") for n in names if n != "text"], text.alias("text"))
