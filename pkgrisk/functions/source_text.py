"""Line statistics of one source file.

A file is a row and is read where it lies: nothing is exploded or shuffled.  One
regular expression splits it into tokens, and a small fold over them counts.
The reading is lexical (braces, attributes, comments, strings); it builds no
syntax tree.  Batches of texts go to it by Arrow.

What counts:
* code lines: lines of items, including their attributes and the comments right
  above them; not ``mod`` heads, free comments or blank lines
* test lines: the same inside a function or module whose attributes mention
  "test"; a test inside a production block counts on both sides
* comment lines: every line a comment touches; block comments nest
* unsafe: the keyword on a block, function, impl or trait
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = (  # any other word, number or punctuation; a run of them is one token
    r"(?:(?!(?:pub|crate|super|self|in|async|const|default|unsafe|extern|mod|fn|impl|trait)\b)"
    r"(?!b?r?#*[\"'])\w++|(?!//|/\*)[^\s\w{}()\[\];\"'#]++)"
)
TOKENS = re.compile(
    r"//[^\n]*"
    r"|/\*"
    r"|\bb?r(#*)\"[\s\S]*?\"\1"
    r"|b?\"[^\"\\]*+(?:\\[\s\S][^\"\\]*+)*+\""
    r"|b?'(?:\\[^']{1,10}|[^\\'\n])'"
    r"|#!?\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\]"
    r"|\n|[{}()\[\];]"
    r"|(?:pub|crate|super|self|in|async|const|default|unsafe|extern|mod|fn|impl|trait)\b"
    rf"|{_PLAIN}(?:[^\S\n]*{_PLAIN})*"
    r"|'?\w+|\S",
    re.ASCII,
)
_COMMENT_EDGE = re.compile(r"/\*|\*/")
_BLANK_LINE = re.compile(r"\n[ \t\r]*(?=\n)")
_STRING_START = re.compile(r'(b?r#*)?b?"')

(_NEWLINE, _COMMENT, _INNER, _ATTR, _TEST_ATTR, _OPEN, _CLOSE, _OPEN2, _CLOSE2, _END, _MODIFIER,
 _MOD, _FN, _UNSAFE, _EXTERN, _BLOCKISH, _STRING, _WORD, _OTHER) = range(19)

_KINDS = {
    "\n": _NEWLINE, "{": _OPEN, "}": _CLOSE, "(": _OPEN2, "[": _OPEN2, ")": _CLOSE2, "]": _CLOSE2, ";": _END,
    "unsafe": _UNSAFE, "extern": _EXTERN, "mod": _MOD, "fn": _FN, "impl": _BLOCKISH, "trait": _BLOCKISH,
} | dict.fromkeys(("pub", "crate", "super", "self", "in", "async", "const", "default"), _MODIFIER)
_HEAD = frozenset((_MODIFIER, _UNSAFE, _EXTERN, _STRING, _OPEN2, _CLOSE2))
_INSIDE = frozenset((_OPEN2, _CLOSE2, _STRING, _WORD, _OTHER))
_HELD = frozenset((_COMMENT, _ATTR, _TEST_ATTR))


def _kind(t: str) -> int:
    if t.startswith(("//!", "/*!", "#![")):
        return _INNER
    if t.startswith(("//", "/*")):
        return _COMMENT
    if t.startswith("#["):
        return _TEST_ATTR if "test" in t else _ATTR
    if _STRING_START.match(t):
        return _STRING
    return _WORD if t[0] == "_" or t[0].isascii() and t[0].isalnum() else _OTHER


def _block_comment(text: str, start: int) -> int:
    """End of the block comment that starts there; one that never ends is not a comment, and ends after its slash."""
    depth = 0
    for edge in _COMMENT_EDGE.finditer(text, start):
        depth += 1 if edge[0] == "/*" else -1
        if not depth:
            return edge.end()
    return start + 1


def tokens(text: str) -> Iterator[str]:
    at = 0
    while at >= 0:
        start, at = at, -1
        for found in TOKENS.finditer(text, start):
            token = found[0]
            if token == "/*":
                # Comments nest, which the expression cannot follow: go on behind this one.
                at = _block_comment(text, found.start())
                yield text[found.start() : at]
                break
            yield token


def statistics(text: str) -> tuple[int, int, int, int, bool]:
    """Production, test and comment lines, unsafe uses, and whether the delimiters do not match."""
    line = depth = pdepth = held = opening = code = test = comments = unsafe = after_unsafe = 0
    seen = held_at = pending = test_at = code_at = test_line = comment_at = -1
    head, broken, settled = True, False, -1
    for t in tokens(text):
        k = _KINDS.get(t)
        if k is None:
            # Inside an item, further words on a line that counts already change nothing.
            if settled == line and t[0] not in "#/" and "\n" not in t and not after_unsafe:
                continue
            k = _kind(t)
        if k == _NEWLINE:
            if seen < line:
                held = 0
            line += 1
            continue
        if depth > 0 and not after_unsafe and k in _INSIDE and "\n" not in t:
            # Words and brackets inside an item only count their line.
            if test_at != 0 and line > code_at:
                code += 1
                code_at = line
            if (test_at >= 0 or opening == 1) and line > test_line:
                test += 1
                test_line = line
            pdepth += (k == _OPEN2) - (k == _CLOSE2)
            broken = broken or pdepth < 0
            seen = line
            settled = line if k >= _STRING else -1
            continue
        many = k != _NEWLINE and "\n" in t
        more = t.count("\n") if many else 0
        blank = len(_BLANK_LINE.findall(t)) if many else 0
        last, deep, trivia = line + more, depth > 0, k <= _TEST_ATTR
        code_token = k > _TEST_ATTR
        # Item heads at the top level are held back until the item shows its kind.
        modifier = k in _HEAD
        at_head = not deep and head
        hold = not deep and (k in _HELD or at_head and modifier)
        decides = at_head and code_token and not modifier
        drops, flush = decides and k == _MOD, decides and k != _MOD
        silent = not deep and opening >= 2 and k != _OPEN  # the rest of a mod head
        opens_test = pending >= 0 and k in (_FN, _MOD)
        now_opening = (1 if k == _FN else 3) if opens_test else 2 if k == _MOD and at_head else opening
        in_test = test_at >= 0 or now_opening == 1 or now_opening == 3 and k == _OPEN
        outer_code = test_at > 0 or test_at < 0 and deep
        counts = k != _NEWLINE and (deep or code_token and not (at_head and modifier) and not drops and not silent)
        to_test, to_code = counts and in_test, counts and (not in_test or outer_code)
        if to_code:
            done = max(code_at, held_at) if flush else code_at
            code += (held if flush else 0) + max(_cover(line, last, done) - blank, 0)
            code_at = last
        if to_test:
            if flush:
                test += held + _cover(line, last, max(test_line, held_at))
            else:
                test += max(_cover(pending if opens_test and k == _FN else line, last, test_line) - blank, 0)
            test_line = last
        if k == _COMMENT or k == _INNER and not t.startswith("#"):
            comments += _cover(line, last, comment_at)
            comment_at = last
        if after_unsafe == 1 and k in (_OPEN, _BLOCKISH) or after_unsafe == 3 and k == _WORD:
            unsafe += 1
        if not trivia:
            if k == _UNSAFE:
                after_unsafe = 1
            elif after_unsafe == 1 and k == _EXTERN or after_unsafe == 2 and k == _STRING:
                after_unsafe = 2
            elif after_unsafe in (1, 2) and k == _FN:
                after_unsafe = 3
            else:
                after_unsafe = 0
        if k == _NEWLINE and seen < line or decides:
            held = 0
        elif hold:
            held += _cover(line, last, held_at)
        if hold:
            held_at = last
        ends = k == _END and pdepth <= 0
        was = depth
        depth += (k == _OPEN) - (k == _CLOSE)
        pdepth += (k == _OPEN2) - (k == _CLOSE2)
        broken = broken or depth < 0 or pdepth < 0
        if not deep and ends or k == _CLOSE and depth <= 0:
            head = True
        elif decides:
            head = False
        if k == _TEST_ATTR and pending < 0:
            pending = line
        elif k == _OPEN or ends or opens_test:
            pending = -1
        if k == _OPEN and now_opening in (1, 3) and test_at < 0:
            test_at = was
        elif k == _CLOSE and depth == test_at:
            test_at = -1
        opening = 0 if k == _OPEN or ends else now_opening
        if k == _NEWLINE:
            line += 1
        else:
            line = seen = last
            settled = line if deep and k >= _STRING else -1
    return code, test, comments, unsafe, broken or depth != 0 or pdepth != 0


def _cover(first: int, last: int, done: int) -> int:
    """How many of the lines first..last lie beyond the last one counted."""
    return max(last - max(first, done + 1) + 1, 0)


_RESULT = (
    "struct<production_lines: bigint, test_lines: bigint, comment_lines: bigint, unsafe_count: bigint, has_errors: boolean>"
)
_ARROW = pa.struct([
    ("production_lines", pa.int64()), ("test_lines", pa.int64()), ("comment_lines", pa.int64()),
    ("unsafe_count", pa.int64()), ("has_errors", pa.bool_()),
])
_NONE = (0, 0, 0, 0, False)


def line_statistics(content: Column) -> Column:
    """``struct<production_lines, test_lines, comment_lines, unsafe_count, has_errors>``; NULL for NULL."""

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [None if t is None else statistics(t) for t in batch.to_pylist()]
            columns = zip(*[_NONE if r is None else r for r in rows], strict=True) if rows else [[]] * len(_ARROW)
            missing = pa.array([r is None for r in rows], pa.bool_())
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], fields=list(_ARROW), mask=missing)

    return F.arrow_udf(read, _RESULT)(content)
