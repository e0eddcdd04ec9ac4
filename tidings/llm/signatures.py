"""MinHash signatures of shingle sets, and the keys of their bands."""

from __future__ import annotations

import numpy as np

from tidings.llm.words import U64, mix

#: A pair of similarity 0.8 shares no band with a probability of (1 - 0.8**4) ** 24 = 3e-6.
BANDS, BAND_ROWS = 24, 4
SIZE = BANDS * BAND_ROWS

_draw = np.random.default_rng(20260101)
#: Odd multipliers and shifts, one of each per value.
TIMES = (_draw.integers(0, 1 << 31, SIZE, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
PLUS = _draw.integers(0, 1 << 32, SIZE, dtype=np.uint32)
SALTS = _draw.integers(0, 1 << 63, BANDS, dtype=np.uint64)
#: Set elements taken at once: their values under all functions fit in a processor's cache.
STEP = 512


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set of 64-bit hashes (which isn't empty)."""
    low = (shingles >> U64(32)).astype(np.uint32)
    out = np.full(SIZE, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(low), STEP):
        values = low[None, k : k + STEP] * TIMES[:, None]
        values += PLUS[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A key for each band of each signature; equal bands of equal number have equal keys."""
    rows = signatures.reshape(len(signatures), BANDS, BAND_ROWS).astype(np.uint64)
    keys = np.broadcast_to(SALTS, rows.shape[:2]).copy()
    for r in range(BAND_ROWS):
        keys = mix(keys * U64(0x9E3779B97F4A7C15) + rows[:, :, r] + U64(1))
    return keys
