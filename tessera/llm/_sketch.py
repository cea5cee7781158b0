"""Fast similarity sketching of sets, for many sets at once."""

from __future__ import annotations

import math

import numpy as np

from tessera.llm._text import mix

EMPTY = np.uint64(2**64 - 1)


def sketch(elements: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """A row of ``size`` coordinates for each set elements[offsets[i]:offsets[i + 1]].

    In each round an element falls into the bin that its hash of the round gives; a bin that no earlier
    round has filled keeps the smallest hash. After ``size`` rounds, round ``size + k`` puts all elements
    into bin k, so every coordinate of a set that isn't empty is filled; almost all sets are full after
    about size * ln(size) / n rounds. Two sets agree in a coordinate with a chance of their Jaccard
    similarity, and the number of agreements is concentrated as that of independent draws. Rows of empty
    sets keep EMPTY.
    """
    n = np.diff(offsets)
    out = np.full((len(n), size), EMPTY)
    flat = out.reshape(-1)
    active = np.flatnonzero(n)
    rounds = 0
    while len(active):
        rounds += 1
        sizes = n[active]
        to = np.cumsum(sizes)
        at = np.repeat(offsets[active] - (to - sizes), sizes) + np.arange(int(to[-1]))
        seed = np.uint64((rounds * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % 2**64)
        h = mix(elements[at] ^ seed)
        row = np.repeat(active, sizes) * size
        if rounds <= size:
            bin_ = row + ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        else:
            bin_ = row + (rounds - size - 1)
        free = flat[bin_] == EMPTY
        bin_, h = bin_[free], h[free]
        np.minimum.at(flat, bin_, h)
        active = active[(out[active] == EMPTY).any(axis=1)]
    return out


def bands_for(similarity: float, rows: int, miss: float = 1e-9) -> int:
    """Bands of so many rows that a pair of this similarity shares none with a chance of at most miss."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def band_keys(sketches: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each set and band."""
    count, size = sketches.shape
    bands = size // rows
    odd = mix(np.arange(1, rows + 1).astype(np.uint64)) | np.uint64(1)
    mixed = mix(sketches[:, : bands * rows].reshape(count, bands, rows)) * odd
    return mix(mixed.sum(axis=2, dtype=np.uint64) + np.arange(1, bands + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
