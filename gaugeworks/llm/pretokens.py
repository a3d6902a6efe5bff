"""Splitting of texts into the pre-tokens of a byte-level BPE."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import regex

# Fixed value: the pre-token pattern of the public 50k vocabulary.
GPT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN = 0x250


def _ranges(prop: str) -> str:
    """A character class body: the code points below LATIN with a Unicode property."""
    has = [bool(regex.match(prop, chr(c))) for c in range(LATIN)] + [False]
    edges = [c for c in range(LATIN + 1) if has[c] != (c > 0 and has[c - 1])]
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edges[::2], edges[1::2], strict=True))


@lru_cache(maxsize=8)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of ``pattern`` in a text.

    Texts of Latin letters only go through the standard library's faster engine with the classes of
    GPT_PATTERN written out; every other text and every other pattern goes through ``regex``.
    """
    general = regex.compile(pattern).findall
    if pattern != GPT_PATTERN:
        return general
    letter, number, space = _ranges(r"\p{L}"), _ranges(r"\p{N}"), _ranges(r"\s")
    latin = re.compile(
        rf" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    ).findall
    other = re.compile(rf"[^\u0000-\u{LATIN - 1:04x}]").search
    return lambda text: general(text) if other(text) else latin(text)
