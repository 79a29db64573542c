"""Counts over whole texts, for a slice of texts at a time.

Words are runs of anything but space and the ASCII controls tab to carriage return. Null counts as empty.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

WINDOW = 5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
KINDS = ("space", "lower", "upper", "digit", "stop", "symbol", "other")
LATIN_END = 0x250
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64): spreads consecutive integers over all bits."""
    x = x.astype(np.uint64) * MIX[0]
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def kind_of(char: str) -> int:
    category = unicodedata.category(char)
    if char.isspace() or category[0] == "Z":
        return 0
    if category in ("Lu", "Lt"):
        return 2
    if category[0] in "LM":
        return 1
    if category[0] == "N":
        return 3
    if char in ".,;:!?'\"()-":
        return 4
    return 5 if category[0] in "PS" else 6


@lru_cache
def kind_table() -> np.ndarray:
    return np.array([kind_of(chr(c)) for c in range(LATIN_END)], np.uint8)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def classified(points: np.ndarray, table: np.ndarray, of) -> np.ndarray:
    """Class of each code point: a table for Latin, ``of(char)`` for each distinct other one."""
    out = table[np.minimum(points, LATIN_END - 1)]
    if len(rare := np.flatnonzero(points >= LATIN_END)):
        values, where = np.unique(points[rare], return_inverse=True)
        out[rare] = np.array([of(chr(v)) for v in values], out.dtype)[where]
    return out


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """Per text: words in 5-word windows that occur twice or more in the text.

    Words and windows are compared by 64-bit hashes, which only have to agree within this call.
    """
    n = np.array([len(w) for w in words], np.int64)
    flat = [w for part in words for w in part]
    if len(flat) < WINDOW:
        return np.zeros(len(words), np.int64)
    codes = mixed(np.fromiter(map(hash, flat), np.int64, len(flat)))
    doc = np.repeat(np.arange(len(words)), n)
    m = len(flat) - WINDOW + 1
    key = mixed(doc[:m] + 1)
    for k in range(WINDOW):
        key = key * MIX[1] + codes[k: k + m]
    starts = np.flatnonzero(doc[:m] == doc[WINDOW - 1:])
    order = np.argsort(key[starts])
    ranked = key[starts][order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = starts[twice]
    cover = np.bincount(at, minlength=len(flat) + 1) - np.bincount(at + WINDOW, minlength=len(flat) + 1)
    return np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=len(words))


def repeated_lines(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and lines with a word."""
    if "\n" not in text:
        return 0, int(bool(text.strip(SPACES)))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines)), len(lines)


def base_counts(texts: list[str], words: list[list[bytes]] | None = None) -> dict[str, np.ndarray]:
    words = split(texts) if words is None else words
    lines = np.array([repeated_lines(t) for t in texts], np.int64).reshape(len(texts), 2)
    whole = lambda xs: np.array(xs, np.int64)
    return {
        "n_words": whole([len(w) for w in words]), "n_chars": whole([len(t) for t in texts]),
        "word_chars": whole([len(t) - sum(map(t.count, SPACES)) for t in texts]),
        "n_symbols": whole([sum(map(t.count, SYMBOLS)) for t in texts]),
        "n_dup_lines": lines[:, 0], "n_lines": lines[:, 1], "n_repeat_words": whole(repeated_words(words)),
    }


def split(texts: list[str]) -> list[list[bytes]]:
    return [t.encode("utf-8", "surrogatepass").split() for t in texts]


def kind_counts(texts: list[str]) -> np.ndarray:
    """Characters of each of KINDS per text."""
    n = np.array([len(t) for t in texts], np.int64)
    kinds = classified(code_points("".join(texts)), kind_table(), kind_of).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), n)
    return np.bincount(doc * len(KINDS) + kinds, minlength=len(texts) * len(KINDS)).reshape(len(texts), len(KINDS))
