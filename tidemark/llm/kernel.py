"""Whole Arrow batches of text as flat numpy arrays of code points.

Every function takes and returns flat arrays over all texts of a slice, with an offset array that says where each
text begins, so no Python loop runs over characters or tokens.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

HAN_FIRST, HAN_LAST = 0x4E00, 0x9FFF
#: Code points worked on at once; a longer text makes a slice of its own.
SLICE_CHARS = 400_000
U64 = np.uint64


@lru_cache(1)
def kinds() -> np.ndarray:
    """By code point: 2 for U+4E00-U+9FFF, 1 for other letters and digits (categories L*, N*), else 0."""
    out = np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), np.uint8, 0x110000)
    out[HAN_FIRST : HAN_LAST + 1] = 2
    return out


@lru_cache(1)
def spaces() -> np.ndarray:
    """By code point: whether ``str.strip`` takes it for white space."""
    out = np.zeros(0x110000, bool)
    out[[c for c in range(0x10000) if chr(c).isspace()]] = True
    return out


def slices(texts: list[str], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of together about ``chars`` code points."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def flatten(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each begins (one more offset for the end)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offsets[1:])
    return codes, offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(8)
def _powers(size: int) -> np.ndarray:
    out = np.full(size, 0x9E3779B97F4A7C15, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def token_hashes(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token, in order, and the number of the text each is in.

    A token is one Han character, or a maximal run of other letters and digits; the texts are lower-cased already.
    """
    kind = kinds()[codes]
    first = np.zeros(len(codes), bool)
    first[offsets[:-1][offsets[:-1] < len(codes)]] = True
    begins = (kind == 2) | ((kind == 1) & (first | (np.concatenate(([0], kind[:-1])) != 1)))
    at = np.flatnonzero(kind)
    if not len(at):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    starts = np.flatnonzero(begins[at])
    position = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    powers = _powers(1 << max(10, int(position.max()).bit_length()))
    letters = mix(codes[at].astype(U64) + U64(1)) * powers[position]
    hashes = mix(np.add.reduceat(letters, starts))
    return hashes, np.searchsorted(offsets, at[starts], "right") - 1


def shingles(hashes: np.ndarray, owner: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``words`` consecutive tokens within a text, and the text of each."""
    n = len(hashes) - words + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = hashes[:n].copy()
    for k in range(1, words):
        out = out * U64(0xD6E8FEB86659FD93) + hashes[k : n + k]
    inside = owner[:n] == owner[words - 1 :]
    return mix(out[inside]), owner[:n][inside]


def unique_by_owner(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each owner; owners in ascending order."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[keep], owner[keep]
