"""Semantic versions as sortable text.

``semver_key`` maps a version to a string whose plain binary order is the
version order, so sorts, ``max_by``, range predicates and window frames all
work on one ordinary column.  Layout:

    major.minor.patch as 20-digit numbers     the "base"
    "~" for a release, else the encoded pre-release identifiers
    "\\x00" and the encoded build identifiers, if there are any

Identifiers are joined by "\\x01".  A numeric identifier is "0", its digit
count and its digits, an alphanumeric one is "1" and its text, which puts
numbers first, in numeric order.  "\\x00" < "\\x01" < every legal character <
"~" gives: fewer identifiers first, pre-release before release, build last.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pkgrisk.functions.let import let

# The grammar of semver.org 2.0.0.
_NUM = r"(0|[1-9]\d*)"
_PRE_ID = r"(?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*)"
SEMVER_PATTERN = (
    rf"^{_NUM}\.{_NUM}\.{_NUM}"
    rf"(?:-({_PRE_ID}(?:\.{_PRE_ID})*))?"
    r"(?:\+([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?$"
)
_U64_MAX = "18446744073709551615"
_WIDTH = 20
# Digits of a text length: no text is longer.
_SIZE_WIDTH = 10

_RELEASE = "~"
_AFTER = "\x00"
_LAST = "\x7f"


def _numbers(c: Column) -> Column:
    """Major, minor and patch of well-formed text, as digits."""
    return F.split(F.substring_index(F.substring_index(c, "+", 1), "-", 1), r"\.")


def _fit(numbers: Column) -> Column:
    """Each number lies inside an unsigned 64-bit integer."""
    padded = [F.lpad(F.get(numbers, F.lit(i)), _WIDTH + 1, "0") for i in range(3)]
    return F.greatest(*padded) <= F.lit(_U64_MAX.rjust(_WIDTH + 1, "0"))


def is_semver(c: Column) -> Column:
    """Well formed, with each number inside an unsigned 64-bit integer."""
    return c.rlike(SEMVER_PATTERN) & F.coalesce(_fit(_numbers(c)), F.lit(False))


def _part(c: Column, group: int) -> Column:
    return F.regexp_extract(c, SEMVER_PATTERN, group)


def _encode_ids(ids: Column) -> Column:
    def one(x: Column) -> Column:
        digits = F.regexp_replace(x, "^0+(?=.)", "")
        size = F.lpad(F.length(digits).cast("string"), _SIZE_WIDTH, "0")
        raw_size = F.lpad(F.length(x).cast("string"), _SIZE_WIDTH, "0")
        return F.when(x.rlike(r"^\d+$"), F.concat(F.lit("0"), size, digits, raw_size)).otherwise(
            F.concat(F.lit("1"), x)
        )

    return F.array_join(F.transform(F.split(ids, r"\."), one), "\x01")


def _pad(digits: Column) -> Column:
    return F.lpad(digits, _WIDTH, "0")


def _tail(c: Column, mark: str) -> Column:
    """What stands after the first ``mark``; empty without one."""
    at = F.instr(c, mark)
    return F.when(at > 0, F.call_function("substring", c, at + 1)).otherwise("")


def semver_base(c: Column) -> Column:
    """Key of major.minor.patch alone; smaller than every version on that line.  NULL for malformed text.

    The pattern is matched once; what it allows can then be cut at its marks.
    """
    key = let(_numbers(c), lambda n: F.when(_fit(n), F.concat(*[_pad(F.get(n, F.lit(i))) for i in range(3)])))
    return F.when(c.rlike(SEMVER_PATTERN), key)


def precedence_key(c: Column) -> Column:
    """Order key without build metadata; NULL for malformed text."""
    pre = _tail(F.substring_index(c, "+", 1), "-")
    return F.concat(semver_base(c), F.when(pre == "", F.lit(_RELEASE)).otherwise(_encode_ids(pre)))


def semver_key(c: Column) -> Column:
    """Total order key; NULL for malformed text."""
    build = _tail(c, "+")
    tail = F.when(build == "", F.lit("")).otherwise(F.concat(F.lit(_AFTER), _encode_ids(build)))
    return F.concat(precedence_key(c), tail)


def is_prerelease(c: Column) -> Column:
    return _part(c, 4) != ""


# --------------------------------------------------------------------------
# Requirements

_REQ_PATTERN = (
    r"^\s*(=|>=|<=|>|<|~|\^|)\s*"
    r"(\d+|[*xX])(?:\.(\d+|[*xX]))?(?:\.(\d+|[*xX]))?"
    rf"(?:-({_PRE_ID}(?:\.{_PRE_ID})*))?(?:\+[0-9A-Za-z.-]+)?\s*$"
)


def _comparator(text: Column) -> Column:
    """One comparator as key bounds.

    ``lo <= key < hi``; inside ``[calm_lo, calm_hi)`` only releases count;
    ``pre_base`` is the base whose pre-releases the comparator lets in.
    """

    def got(i: int) -> Column:
        return F.regexp_extract(text, _REQ_PATTERN, i)

    def number(i: int) -> Column:
        return F.when(got(i).rlike(r"^\d+$"), got(i).try_cast("decimal(20,0)"))

    # A number beyond an unsigned 64-bit integer is malformed, as in a version.
    fits = F.forall(
        F.array(got(2), got(3), got(4)),
        lambda x: F.when(x.rlike(r"^\d+$"), F.coalesce(x.try_cast("decimal(20,0)") <= F.expr(f"{_U64_MAX}BD"), F.lit(False))).otherwise(True),
    )

    read = F.struct(
        got(1).alias("op"),
        number(2).alias("major"),
        number(3).alias("minor"),
        number(4).alias("patch"),
        got(5).alias("pre"),
        F.exists(F.array(got(2), got(3), got(4)), lambda x: x.rlike(r"^[*xX]$")).alias("wild"),
    )
    return F.when(text.rlike(_REQ_PATTERN) & fits, let(let(read, _lines), _bounds))


_ZERO = "0BD"


def _base(major: Column, minor: Column, patch: Column) -> Column:
    return F.concat(*[_pad(x.cast("string")) for x in (major, minor, patch)])


def _lines(r: Column) -> Column:
    """The stretch of versions that agree with the stated numbers, and the exact key."""
    major, minor, patch, pre = r["major"], r["minor"], r["patch"], r["pre"]
    zero = F.expr(_ZERO)
    lo = _base(major, F.coalesce(minor, zero), F.coalesce(patch, zero))
    hi = F.when(minor.isNull(), _base(major + 1, zero, zero)).when(patch.isNull(), _base(major, minor + 1, zero))
    tail = F.when(pre == "", F.lit(_RELEASE)).otherwise(_encode_ids(pre))
    return F.struct(r.alias("r"), lo.alias("lo"), hi.alias("hi"), F.concat(lo, tail).alias("exact"))


def _bounds(line: Column) -> Column:
    r, line_lo, line_hi, exact = line["r"], line["lo"], line["hi"], line["exact"]
    op, major, minor, patch, wild = r["op"], r["major"], r["minor"], r["patch"], r["wild"]
    zero, lowest, highest = F.expr(_ZERO), F.lit(""), F.lit(_LAST)
    full = patch.isNotNull()
    start = F.when(full, exact).otherwise(line_lo)
    past = F.when(full, F.concat(exact, F.lit(_AFTER))).otherwise(line_hi)
    next_minor = F.when(minor.isNull(), _base(major + 1, zero, zero)).otherwise(_base(major, minor + 1, zero))
    next_breaking = (
        F.when(minor.isNull() | (major > 0), _base(major + 1, zero, zero))
        .when(patch.isNull() | (minor > 0), _base(major, minor + 1, zero))
        .otherwise(_base(major, minor, patch + 1))
    )
    any_version = major.isNull()
    lo = F.when(any_version | op.isin("<", "<="), lowest).when(op == ">", past).otherwise(start)
    hi = (
        F.when(any_version | op.isin(">", ">="), highest)
        .when(op == "<", start)
        .when((op == "=") | (op == "<=") | wild, past)
        .when(op == "~", next_minor)
        .otherwise(next_breaking)
    )
    calm = ~full & ~wild & op.isin("=", ">=", "<=", "~")
    return F.struct(
        lo.alias("lo"),
        hi.alias("hi"),
        F.when(calm, line_lo).otherwise(highest).alias("calm_lo"),
        F.when(calm, line_hi).otherwise(lowest).alias("calm_hi"),
        F.when(r["pre"] != "", line_lo).alias("pre_base"),
    )


def comparators(req: Column) -> Column:
    """The comma separated comparators of a requirement as bounds structs."""
    return F.transform(F.split(req, ","), _comparator)


def requirement_interval(req: Column) -> Column:
    """``struct<lo, hi>`` in plain version order; NULL for malformed text."""
    parts = comparators(req)
    lo = F.array_max(F.transform(parts, lambda p: p["lo"]))
    hi = F.array_min(F.transform(parts, lambda p: p["hi"]))
    sound = F.forall(parts, lambda p: p.isNotNull())
    return F.when(sound, F.struct(lo.alias("lo"), hi.alias("hi")))


def requirement_matches(version: Column, req: Column) -> Column:
    """Does the version satisfy the requirement?

    A pre-release also needs a comparator that names a pre-release of the same
    major.minor.patch.  NULL when either text is malformed.
    """
    key, base, pre = precedence_key(version), semver_base(version), is_prerelease(version)
    parts = comparators(req)
    inside = F.forall(
        parts,
        lambda p: (key >= p["lo"])
        & (key < p["hi"])
        & ~(pre & (key >= p["calm_lo"]) & (key < p["calm_hi"])),
    )
    let_in = F.exists(parts, lambda p: F.coalesce(p["pre_base"] == base, F.lit(False)))
    sound = F.forall(parts, lambda p: p.isNotNull()) & key.isNotNull()
    return F.when(sound, inside & (~pre | let_in))
