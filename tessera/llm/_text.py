"""Vectorised words and fingerprints over UTF-8 bytes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; in UTF-8 these bytes occur only as
the characters themselves, so byte runs and character runs are the same words. All work is done on
numpy arrays in slices of about a megabyte, so memory doesn't grow with a document's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(0, 2**61, dtype=np.uint64)) * 8 + 5
_SLICE = 1 << 20
_LONG = 1024
#: Masks of the first k bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(n, b, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each range of values its polynomial hash; it doesn't depend on where the range lies."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:], dtype=np.uint64)
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (start, end) of the words of buf."""
    gap = np.ones(len(buf) + 2, dtype=bool)
    gap[1:-1] = SPACE[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of words, eight bytes at a time; words of over _LONG bytes by a hash of all their bytes."""
    raw = np.zeros(len(buf) + 8, np.uint8)
    raw[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), "<u8", buffer=raw, strides=(1,))
    n = ends - starts
    out = mix((eight[starts] & _FIRST[np.minimum(n, 8)]) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at, done = np.flatnonzero((n > 8) & (n <= _LONG)), 8
    while len(at):
        left = n[at] - done
        out[at] = mix(out[at] * np.uint64(0xD6E8FEB86659FD93) + (eight[starts[at] + done] & _FIRST[np.minimum(left, 8)]))
        at, done = at[left > 8], done + 8
    for i in np.flatnonzero(n > _LONG):
        out[i] = range_hashes(_BYTE[buf[starts[i] : ends[i]]], np.zeros(1, np.int64), n[i : i + 1])[0]
    return out


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all runs of width consecutive words; len(words) - width + 1 of them."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for i in range(0, n, _SLICE):
        j = min(n, i + _SLICE)
        at = np.arange(j - i)
        out[i:j] = range_hashes(words[i : j + width - 1], at, at + width)
    return out


def window_starts(counts: np.ndarray, width: int) -> np.ndarray:
    """Word indexes at which a run of width words stays inside its document; counts: words of each."""
    total = int(counts.sum())
    ok = np.ones(total, dtype=bool)
    if width > 1 and total:
        ends = np.cumsum(counts)
        for back in range(1, width):
            at = ends - back
            ok[at[at >= ends - counts]] = False
    return np.flatnonzero(ok)


def shingle_sets(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document: (fingerprints sorted within documents, offsets).

    A document with fewer words than width has its whole sequence as one shingle; without words, none.
    """
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    at = window_starts(counts, width)
    h = windows(words, width)[at] if len(at) else np.empty(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = range_hashes_sliced(words, first[short], first[short] + counts[short])
        h, docs = np.concatenate([h, whole]), np.concatenate([owner[at], short])
    else:
        docs = owner[at]
    order = np.lexsort((h, docs))
    h, docs = h[order], docs[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (docs[1:] != docs[:-1])
    h, docs = h[new], docs[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=len(counts)))]).astype(np.int64)


def range_hashes_sliced(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """range_hashes for short ranges that may lie far apart."""
    sizes = ends - starts
    to = np.cumsum(sizes)
    at = np.repeat(starts - (to - sizes), sizes) + np.arange(int(to[-1]) if len(to) else 0)
    return range_hashes(values[at], to - sizes, to)


def slices(column: pa.Array, limit: int = _SLICE) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """(first, end, texts as bytes) for runs of rows of about so many bytes; a longer text is a run of its own.

    Only one run at a time is copied out of the Arrow batch.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        yield i, j, column.slice(i, j - i).cast(pa.large_binary()).to_pylist()
        i = j
