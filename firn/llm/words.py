"""Words and shingles of whole texts as 64-bit hashes, vectorised over an Arrow batch.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``; A-Z count as a-z. A word's hash is a
polynomial in random 64-bit values of its bytes, taken as a difference of prefix sums, then
mixed. Two different words (or shingles) share a hash with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_U = np.uint64
_SPACES = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_values() -> tuple[np.ndarray, np.ndarray]:
    byte = np.arange(256)
    lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
    space = np.zeros(256, dtype=bool)
    space[_SPACES] = True
    return mix((lower.astype(np.uint64) + _U(1)) * _U(0xD6E8FEB86659FD93)), space


_VALUE, _IS_SPACE = _byte_values()


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 1, 2 * len(self.up))
            steps = np.full(size, _BASE, np.uint64)
            back = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            steps[0] = back[0] = 1
            self.up, self.down = np.multiply.accumulate(steps), np.multiply.accumulate(back)
        return self.up, self.down


_POWERS = _Powers()


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without nulls, offsets from 0."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def hashed_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts as (index of the first text, word hashes, first word of each text and the end).

    A run holds about half a megabyte, or one longer text, so temporary arrays stay bounded
    by the longest text. A null text has no words.
    """
    if not len(texts):
        return
    raw, offsets = _buffer(texts.fill_null(""))
    first = 0
    while first < len(texts):
        stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        at = offsets[first : stop + 1] - offsets[first]
        data = raw[offsets[first] : offsets[stop]]
        if len(data):
            hashes, starts = _hash_run(data, at)
            yield first, hashes, np.searchsorted(starts, at)
        else:
            yield first, np.empty(0, np.uint64), np.zeros(stop - first + 1, np.int64)
        first = stop


def _hash_run(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = _IS_SPACE[data]
    opens = ~space
    closes = opens.copy()
    edges = np.unique(at[(at > 0) & (at < len(data))])
    inside = opens[edges], opens[edges - 1]
    opens[1:] &= space[:-1]
    closes[:-1] &= space[1:]
    opens[edges], closes[edges - 1] = inside
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of each text, and each text's bounds in them.

    A text with fewer words (but at least one) has its whole sequence as its one shingle.
    """
    words = np.diff(bounds)
    count = np.maximum(words - size + 1, (words > 0).astype(np.int64))
    out_bounds = np.concatenate(([0], np.cumsum(count)))
    total = int(out_bounds[-1])
    owner = np.repeat(np.arange(len(words)), count)
    place = bounds[:-1][owner] + np.arange(total) - out_bounds[:-1][owner]
    length = np.minimum(words[owner], size)
    value = length.astype(np.uint64)
    for step in range(size):
        here = step < length
        word = hashes[np.where(here, place + step, 0)] if len(hashes) else np.empty(0, np.uint64)
        value = np.where(here, mix(value * _U(0xA0761D6478BD642F) + word), value)
    return value, out_bounds


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after the other."""
    for _, hashes, bounds in hashed_words(texts):
        values, at = shingles(hashes, bounds, size)
        for i in range(len(at) - 1):
            yield np.unique(values[at[i] : at[i + 1]])
