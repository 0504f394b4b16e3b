"""Words and keys that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes of a word: digits, small letters and everything outside ASCII; A-Z are lower-cased first.
_WORD_BYTES = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b in _WORD_BYTES else 32
    for b in range(256)
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, with A-Z lower-cased; null has none."""
    return utf8(text).translate(_FOLD).split()


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_array(text: Column) -> Column:
    """The same words as :func:`words_of`, as an array; null gives an empty array."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that further columns of the input can't clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])
