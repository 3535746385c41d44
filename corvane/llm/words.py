"""Hashes of the words of many texts at once.

A word's hash is a polynomial over its bytes, modulo 2^64, mixed at the end. It comes from prefix sums over the whole
buffer, so no word becomes a Python object.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from xxhash import xxh64_intdigest

_BASE = np.uint64(xxh64_intdigest("word base") | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def folding(blanks: bytes) -> np.ndarray:
    """The value of each byte: 0 for the given blanks, and the same for A-Z as for a-z."""
    values = np.array([xxh64_intdigest(f"byte {b}") | 1 for b in range(256)], np.uint64)
    values[list(string.ascii_uppercase.encode())] = values[list(string.ascii_lowercase.encode())]
    values[list(blanks)] = 0
    return values


#: Words between ASCII blanks, and between those, ASCII punctuation and zero characters.
BLANKS = folding(b" \t\n\r\x0b\x0c")
PUNCTUATION = folding(b" \t\n\r\x0b\x0c\x00" + string.punctuation.encode())


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, x, np.uint64))]) for x in (_BASE, _INVERSE))


_known = _powers(1 << 19)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the base and its inverse, from 0 to n or more."""
    return _known if n < _known[0].size else _powers(n)


def word_hashes(text: bytes, values: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and the byte at which it starts."""
    found = values[np.frombuffer(text, np.uint8)]
    inside = np.concatenate([[False], found != 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    base, back = powers(found.size)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(found * base[: found.size], dtype=np.uint64)])
    return mix((sums[end] - sums[start]) * back[start]), start


def joined(texts: list[bytes], values: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """The words of all texts: their hashes, the text of each, where each starts in the joined texts, and these."""
    text = b"\n".join(texts)
    hashes, start = word_hashes(text, values)
    first = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    return hashes, np.searchsorted(first, start, "right") - 1, start, text


def slabs(texts: pa.Array | list[bytes], size: int = 1 << 18):
    """The first place and the values of some texts at a time, of about ``size`` bytes in all or one text."""
    group, total = [], 0
    for k, t in enumerate(texts):
        group.append(t if isinstance(t, bytes) else t.as_py() or b"")
        total += len(group[-1])
        if total >= size:
            yield k + 1 - len(group), group
            group, total = [], 0
    if group:
        yield len(texts) - len(group), group


def words_of(texts: list[bytes], values: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """As ``joined``, without the places, for texts of any size in all."""
    parts = [(h, text + begin) for begin, group in slabs(texts) for h, text, _, _ in (joined(group, values),)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
