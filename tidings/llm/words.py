"""Words of UTF-8 text and their hashes, for whole texts at once with numpy.

A word is a longest run of bytes other than space and the controls 0x09 to 0x0D. Hashes are 64-bit
polynomials over a word's bytes, taken from prefix sums, then mixed.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class Powers:
    """Powers of an odd number modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base = base
        self.known = np.ones(1, dtype=U64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            step = U64(pow(self.base, len(self.known), 1 << 64))
            self.known = np.concatenate([self.known, self.known * step])
        return self.known[:n]


UP, DOWN = Powers(BASE), Powers(INVERSE)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where words start and end."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[data]
    steps = np.diff(inside)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of every span."""
    n = len(data)
    prefix = np.zeros(n + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * UP.upto(n), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * DOWN.upto(n + 1)[starts])


def word_hashes(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, dtype=np.uint8)
    return span_hashes(data, *spans(data))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.zeros(n, dtype=U64)
    for k in range(width):
        out = (out + hashes[k : k + n]) * U64(BASE)
    return mix(out)


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """The set of ``width``-word shingles, sorted; a shorter text with a word is one shingle."""
    hashes = word_hashes(text)
    if 0 < len(hashes) < width:
        return windows(hashes, len(hashes))
    return np.unique(windows(hashes, width))
