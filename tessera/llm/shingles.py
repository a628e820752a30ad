"""Distinct word shingles of texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; of fewer words, one of them all; of none, none.

    Bytes are lower-cased and split by A-Z and ASCII white space alone, as words ``[^\\x20\\x09-\\x0D]+`` are.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    out = hashes[:n]
    for k in range(1, size):
        out = mix(out * _STEP + hashes[k:k + n])
    return np.unique(out)
