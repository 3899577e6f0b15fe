"""Words and word shingles of whole Arrow batches, hashed with numpy over the UTF-8 bytes.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. Its 64-bit hash is a polynomial over its
bytes, taken for all words at once from running sums; a shingle's hash mixes the hashes of its words. Equal words and
shingles have equal hashes; different ones meet with probability about 2^-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
SLICE_BYTES = 2 << 20  # texts handled at once; a longer text is handled alone

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES) + 1
        made = []
        for base in (_BASE, _BASE_INVERSE):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            made.append(np.multiply.accumulate(powers))
        _POWERS[:] = made
    return _POWERS


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the bounds of each text among them; null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    bounds = bounds.astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), bounds * 0
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each piece stay near SLICE_BYTES."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    piece = (np.cumsum(lengths, dtype=np.int64) - 1) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


class Words:
    """The words of some texts: ``hashes``, byte bounds ``start``/``end``, and ``of``: text i has words of[i]..of[i+1]."""

    def __init__(self, column: pa.Array):
        data, bounds = utf8(column)
        self.data, self.bounds = data, bounds
        inside = ~_SEPARATOR[data]
        first = np.zeros(len(data) + 1, bool)
        first[bounds] = True
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | first[1:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | first[1:-1]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.of = np.searchsorted(self.start, bounds)
        powers, inverse = _powers(len(data))
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LOWER[data] * powers[:len(data)], out=self._sums[1:])
        self._inverse = inverse
        self.hashes = self.prefix_hashes(self.end)

    def prefix_hashes(self, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from each word's start to ``end``."""
        raw = (self._sums[end] - self._sums[self.start]) * self._inverse[self.start]
        return mix(raw + (end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def shingles(self, width: int = SHINGLE) -> list[np.ndarray]:
        """Per text its distinct shingle hashes, sorted; fewer words than ``width`` make one shingle, no word none."""
        n = len(self.hashes)
        hashes = self.hashes
        out = []
        if n >= width:
            total = np.zeros(n - width + 1, np.uint64)
            for k in range(width):
                total += mix(hashes[k:n - width + 1 + k] + np.uint64(k + 1))
                total *= np.uint64(0x2545F4914F6CDD1D)
            total = mix(total)
        for a, b in zip(self.of.tolist(), self.of[1:].tolist()):
            if b - a >= width:
                out.append(np.unique(total[a:b - width + 1]))
            else:
                out.append(whole_hash(hashes[a:b]))
        return out

    def shingle_runs(self, width: int = SHINGLE) -> list[np.ndarray]:
        """Per text its shingle hashes in order of position, repeats included."""
        n, hashes = len(self.hashes), self.hashes
        total = np.zeros(max(0, n - width + 1), np.uint64)
        for k in range(width if n >= width else 0):
            total += mix(hashes[k:n - width + 1 + k] + np.uint64(k + 1))
            total *= np.uint64(0x2545F4914F6CDD1D)
        total = mix(total)
        return [total[a:b - width + 1] if b - a >= width else whole_hash(hashes[a:b])
                for a, b in zip(self.of.tolist(), self.of[1:].tolist())]


def whole_hash(hashes: np.ndarray) -> np.ndarray:
    """The one shingle of a text with few words; empty for a text without words."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    total = np.uint64(len(hashes)) * np.ones(1, np.uint64)
    for h in hashes:
        total = mix(total * np.uint64(0xA0761D6478BD642F) + h)
    return total


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes of each span, A-Z lower-cased; for spans cut by other separators than those of Words."""
    powers, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data] * powers[:len(data)], out=sums[1:])
    raw = (sums[end] - sums[start]) * inverse[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def take_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes of each span."""
    bounds = np.concatenate([[0], np.cumsum(end - start)])
    places = np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], end - start)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()),
                                                           pa.py_buffer(np.ascontiguousarray(data[places]).tobytes())])
