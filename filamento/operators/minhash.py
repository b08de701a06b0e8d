"""Character n-gram sets and MinHash values in numpy, for use inside Arrow steps."""

from __future__ import annotations

import re

import numpy as np

_SPACE = re.compile(r"\s+")
_RNG = np.random.default_rng(11)
ORDERS = 318
_MULTIPLY = (_RNG.integers(0, 1 << 63, ORDERS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def grams(text: str | None) -> np.ndarray:
    """Sorted distinct character 3-grams without white space, packed exactly; a shorter text is one."""
    a = np.frombuffer(_SPACE.sub("", text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(a):
        return np.zeros(0, np.uint64)
    if len(a) < 3:
        a = np.r_[a, np.zeros(3 - len(a), np.uint64)]
    return np.unique((a[:-2] << np.uint64(42)) | (a[1:-1] << np.uint64(21)) | a[2:])


def signature(g: np.ndarray) -> np.ndarray:
    x = g * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return ((x[None] * _MULTIPLY[:, None]) >> np.uint64(32)).min(1) if len(x) else np.zeros(ORDERS, np.uint64)


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit value per band of ``rows`` minima."""
    m = sig[: len(sig) // rows * rows].reshape(-1, rows)
    h = np.arange(len(m), dtype=np.uint64)
    for k in range(rows):
        h = (h ^ m[:, k]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)
