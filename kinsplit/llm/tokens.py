"""Vectorised hashing of words and shingles over UTF-8 bytes.

A word's hash is a polynomial over random byte values modulo 2**64, read off prefix
sums, so a whole text costs a few passes of numpy whatever its words.
"""

from __future__ import annotations

import numpy as np


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD1342543DE82EF95)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)

#: Lower case for A-Z only; words are runs of anything but these six separators.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: For comparison without punctuation: words are runs of letters, digits and bytes beyond ASCII.
NOT_ALPHANUMERIC = np.ones(256, bool)
NOT_ALPHANUMERIC[48:58] = NOT_ALPHANUMERIC[65:91] = NOT_ALPHANUMERIC[97:123] = NOT_ALPHANUMERIC[128:] = False


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            _powers = tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64)))) for b in (_BASE, _INVERSE))
    return _powers


def text_bytes(text: str | None) -> np.ndarray:
    """UTF-8 bytes with A-Z in lower case; lone surrogates, which UTF-8 lacks, become '?'."""
    return LOWER[np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)]


def spans(data: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in these bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separator[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, separator: np.ndarray = SEPARATOR) -> np.ndarray:
    """A 64-bit hash for each word; equal words, equal hashes."""
    start, end = spans(data, separator)
    power, inverse = _up_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start])


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words; with fewer words, one for them all; none without words."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = out * _BASE + words[k : len(words) - size + 1 + k]
    return mix(out + np.uint64(size))
