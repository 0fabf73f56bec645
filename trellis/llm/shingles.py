"""Distinct word shingles of texts as sorted 64-bit hashes, computed on Arrow's own bytes.

Words are maximal runs of bytes outside space and tab to carriage return, A-Z lower-cased. A word's
hash is a polynomial over a random table of byte values, taken as a difference of prefix sums, so a
batch is hashed without a Python object per word; a shingle's hash mixes its words' in order. Two
different shingles agree by chance once in 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
CHUNK = 1 << 20  # bytes hashed at a time; one text is never split


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


class _Powers:
    up = _powers(_R, 1 << 16)
    down = _powers(_RINV, 1 << 16)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            cls.up, cls.down = _powers(_R, 2 * n), _powers(_RINV, 2 * n)
        return cls.up, cls.down


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of UTF-8 bytes."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _Powers.of(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return start, mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_sets(text: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its k-word shingles) of every row of a string array.

    A text with fewer than k words has its whole sequence as one shingle; one without words, or null,
    has none.
    """
    text = text.cast(pa.large_string())
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int64)[text.offset: text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(text):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        stop = min(stop, len(text))
        lo, hi = offsets[row], offsets[stop]
        # a space between texts keeps words apart
        part = data[lo:hi]
        cuts = offsets[row: stop + 1] - lo
        sep = np.full(len(part) + stop - row, 32, np.uint8)
        keep = np.ones(len(sep), bool)
        keep[cuts[1:] + np.arange(stop - row)] = False
        sep[keep] = part
        start, words = word_hashes(sep)
        first = np.searchsorted(start, cuts[:-1] + np.arange(stop - row))
        last = np.append(first[1:], len(start))
        mixed = words.copy()
        for j in range(1, k):
            mixed[: len(words) - j] = mix64(mixed[: len(words) - j] * np.uint64(0x9FB21C651E98DF25) + words[j:])
        for i, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
            if b - a >= k:
                h = np.unique(mixed[a: b - k + 1])
            elif b > a:
                one = int(words[a])
                for x in words[a + 1: b]:
                    one = int(mix64(np.array([(one * 0x9FB21C651E98DF25 + int(x)) & (1 << 64) - 1], np.uint64))[0])
                # marked by its length, so that a short text never meets a full shingle
                h = mix64(np.array([one ^ (b - a)], np.uint64))
            else:
                h = np.zeros(0, np.uint64)
            yield row + i, h
        row = stop


def fingerprint(h: np.ndarray) -> bytes:
    """128 bits of a set: equal for equal sets, by chance for others once in 2^128."""
    with np.errstate(over="ignore"):
        return np.array([mix64(h ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64), mix64(h + np.uint64(0x8CB92BA72F3D8DD7)).sum(dtype=np.uint64)], np.uint64).tobytes()
