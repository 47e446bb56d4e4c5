"""Splitting texts into the pre-tokens of the public BPE vocabularies.

The patterns are written out over explicit code point classes, as the standard
``re`` module has none for Unicode categories; it is several times faster than
a backtracking engine with property classes.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

# White space in Unicode, as the splitting patterns' \s has it.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# The splitting patterns of the two vocabularies. Contractions
# begin with a quote, so letters and digits can be tried before them.
_BYTE_PATTERN = " ?[{L}]+| ?[{N}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
_WORD_PATTERN = "[{L}]+|[{N}]|'(?:s|t|re|ve|m|ll|d)|[^{S}{L}{N}]+"


@cache
def _category(first: str) -> str:
    """The body of a character class with every code point of a major category."""
    out, begin = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == first
        if inside and begin is None:
            begin = c
        elif not inside and begin is not None:
            out.append(f"\\U{begin:08x}-\\U{c - 1:08x}")
            begin = None
    return "".join(out)


@cache
def _compiled(pattern: str, ascii_only: bool) -> re.Pattern:
    if ascii_only:
        return re.compile(pattern.format(L="A-Za-z", N="0-9", S="\\t-\\r "))
    return re.compile(pattern.format(L=_category("L"), N=_category("N"), S=_SPACE))


def byte_level(text: str) -> list[str]:
    """Pre-tokens of the byte-level vocabulary; together they are the text."""
    return _compiled(_BYTE_PATTERN, text.isascii()).findall(text)


def byte_chunks(text: str) -> list[str]:
    """Longer pieces than pre-tokens, cut before spaces, that can be split into
    pre-tokens one by one. Where a cut would fall into a run of white space that
    stays together, the text is one piece."""
    if _compiled("[{S}] (?:[{S}]|\\Z)", text.isascii()).search(text):
        return [text]
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


def word_chunks(text: str) -> list[str]:
    """Pieces between white space; ``str.split`` also cuts at four control
    characters that the pattern does not take for white space."""
    return [text] if _CONTROLS.search(text) else text.split()


_CONTROLS = re.compile("[\x1c-\x1f]")


def normalise_words(text: str) -> str:
    """NFC and lower case, character by character (no final-sigma rule)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    if "Σ" in text:
        text = text.replace("Σ", "σ")
    return text.lower()


def word_level(text: str) -> list[str]:
    """Pre-tokens of the vocabulary with word ends; white space is dropped."""
    return _compiled(_WORD_PATTERN, text.isascii()).findall(text)


@cache
def byte_chars() -> dict[int, str]:
    """Byte -> the printable character that stands for it in vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def specials_splitter(strings: list[str]) -> re.Pattern | None:
    """Cuts a raw text at special strings, which the libraries find first."""
    return re.compile("(" + "|".join(sorted(map(re.escape, strings), key=len, reverse=True)) + ")") if strings else None
