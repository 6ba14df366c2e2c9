"""64-bit hashes of the words of many texts at once, in numpy. A word is a run of bytes other than ASCII white space."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: Bytes of text that are hashed together; longer words and texts take as many as they need.
TOGETHER = 1 << 17
_FACTOR = np.uint64(0xBF58476D1CE4E5B9)
#: The base of the words' polynomial hashes; its inverse modulo 2 ** 64 takes a word's place back out.
_BASE = 0xD1342543DE82EF95
_SPACE = re.compile(rb"[\t-\r ]")


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _FACTOR
    return (h ^ (h >> np.uint64(27))) * np.uint64(0x9E3779B97F4A7C15)


def _byte_values(lower: bool) -> np.ndarray:
    """A 64-bit value for each byte; with ``lower``, the same for A-Z and a-z."""
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[65:91] += np.uint64(32)
    return mixed((codes + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))


_VALUES = {lower: _byte_values(lower) for lower in (False, True)}
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _hashes(data: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and where it starts: sums of byte values times powers, from running totals."""
    hashes, starts, at = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)], 0
    while at < len(data):
        cut = _SPACE.search(data, at + TOGETHER)
        end = cut.end() if cut else len(data)
        part = np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)
        inside = np.concatenate([[False], ~_IS_SPACE[part], [False]]).astype(np.int8)
        edges = np.diff(inside)
        first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        size = 1 << (len(part) + 1).bit_length()
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[lower][part] * _powers(_BASE, size)[: len(part)], out=total[1:])
        hashes.append(mixed((total[last] - total[first]) * _powers(pow(_BASE, -1, 1 << 64), size)[first]))
        starts.append(first + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def word_hashes(texts: list[bytes], *, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and the number of words of each text."""
    hashes, starts = _hashes(b"\n".join(texts), lower)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return hashes, np.diff(np.searchsorted(starts, ends), prepend=0)
