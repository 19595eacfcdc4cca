"""64-bit hashes of words and word sequences, stable across processes."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def sequences(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every n words in a row; empty with fewer words."""
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    base = _A if not seed else mix(np.array([seed], np.uint64))[0] | np.uint64(1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * base + h[k: k + count]
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` values in a row."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
