"""Piece tables of public tokenizer files, read with the library that owns the format."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

# The character that stands for a space in pieces.
SPACE = "▁"


class Piece(NamedTuple):
    id: int
    text: str
    score: float
    kind: str  # normal, byte, or other (control, unknown, unused)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def pieces(model: str) -> tuple[Piece, ...]:
    """All pieces of a sentencepiece model; their number is fixed by the file."""
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=model)

    def kind(i: int) -> str:
        if own.is_byte(i):
            return "byte"
        return "other" if own.is_control(i) or own.is_unknown(i) or own.is_unused(i) else "normal"

    return tuple(Piece(i, own.id_to_piece(i), own.get_score(i), kind(i)) for i in range(own.get_piece_size()))


# Latin letters, ASCII signs but the space, and what is neither of them nor a space.
_LETTER, _SIGN, _OTHER = r"A-Za-z\u00C0-\u024F", r"\x00-\x1F!-@\[-`{-\x7F", r"^\x00-\x7F\u00C0-\u024F"


@lru_cache(maxsize=4)
def word_pattern(model: str) -> str:
    """Pattern (for Java and Python) of the words of a text, each with the spaces before it; no piece reaches from one to the next.

    No piece holds a space after another character.  Where no piece holds a letter beside a sign either, words end there too, unless
    they hold other characters.
    """
    beside = re.compile(f"[{_LETTER}][{_SIGN}]|[{_SIGN}][{_LETTER}]")
    texts = [p.text for p in pieces(model) if p.kind == "normal"]
    if any(re.search(f"[^{SPACE}]{SPACE}", t) for t in texts):
        raise ValueError("the vocabulary has pieces of several words")
    if any(beside.search(t) for t in texts):
        return " *+[^ ]++| +"
    return f" *+(?:[{_LETTER}]++(?![{_OTHER}])|[{_SIGN}]++(?![{_OTHER}])|[^ ]++)| +"
