"""Words and contents of a text, as the operators on whole texts compare them."""

from __future__ import annotations

import unicodedata

import regex

OUTER = regex.compile(r"^[^\p{L}\p{M}\p{Nd}]+|[^\p{L}\p{M}\p{Nd}]+$")
INNER = regex.compile(r"[^\p{L}\p{M}\p{Nd}]+")
FIELD = regex.compile(r"\s*([^:|\n]{1,60}?)\s*:(?!//)(.*)", regex.DOTALL)
MIN_FIELDS = 3


def words(text: str) -> list[str]:
    """The pieces between whitespace in lower case, cut at both ends down to letters, marks and digits; empty ones go."""
    out = []
    for piece in text.lower().split():
        first, last = piece[0], piece[-1]
        if not ((first.isalpha() or first.isdecimal()) and (last.isalpha() or last.isdecimal())):
            piece = OUTER.sub("", piece)
            if not piece:
                continue
        out.append(piece)
    return out


def letters(text: str) -> str:
    """Letters, marks and digits of a text in one composed, case-folded form."""
    text = text if text.isascii() else unicodedata.normalize("NFC", text)
    return INNER.sub("", text if text.isascii() else unicodedata.normalize("NFC", text.casefold())).lower()


def fields(text: str) -> list[str] | None:
    """The ``name: value`` fields that make up the whole text, or None where it has fewer than three or anything else."""
    if text.count(":") < MIN_FIELDS:
        return None
    parts = [part for part in (text.split("|") if "|" in text else text.split("\n")) if part.strip()]
    if len(parts) < MIN_FIELDS or not all(FIELD.match(part) for part in parts):
        return None
    return parts


def content(text: str) -> str:
    """What two texts of the same content have in common: their letters, fields in sorted order."""
    parts = fields(text)
    return letters(text) if parts is None else "".join(sorted(map(letters, parts)))
