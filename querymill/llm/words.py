"""Words of whole Arrow text columns as numpy arrays: spans, 64-bit hashes, shingles.

A batch is worked on in slices of a few megabytes, so memory does not grow with the batch. Two
different words or shingles share a 64-bit hash with a chance of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Separators of the two word definitions, as bytes of UTF-8.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes(i for i in range(0x80) if not chr(i).isalnum())

SLICE_BYTES = 2 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
#: Odd factors, one for each word of a shingle.
_FACTORS = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values spread over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
    left = ends - starts
    h = mixed(left.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 + seed))
    h = mixed(h ^ (eights[starts] & _MASKS[np.minimum(left, 8)]))
    more = np.flatnonzero(left > 8)
    at = starts[more] + 8
    while len(more):
        rest = ends[more] - at
        h[more] = mixed(h[more] ^ (eights[at] & _MASKS[np.minimum(rest, 8)]))
        go = rest > 8
        more, at = more[go], at[go] + 8
    return h


def first_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Length and first eight bytes of each span in 64 bits, to check an equal hash by."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
    left = ends - starts
    return (eights[starts] & _MASKS[np.minimum(left, 8)]) + left.astype(np.uint64) * _FACTORS[0]


def slices(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each, at least one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    total, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


class Words:
    """Words of each text of a column: ``starts`` and ``ends`` in ``data``, ``first`` by text."""

    def __init__(self, column: pa.Array, separators: bytes = SPACES):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
        self.data, self.offsets = data, offsets - offsets[0]
        is_word = np.ones(256, bool)
        is_word[list(separators)] = False
        word = is_word[data]
        edges = self.offsets[:-1][self.offsets[:-1] < len(data)]
        before = np.zeros(len(data), bool)
        before[1:] = word[:-1]
        before[edges] = False
        self.starts = np.flatnonzero(word & ~before)
        after = np.zeros(len(data), bool)
        after[:-1] = word[1:]
        after[edges[edges > 0] - 1] = False
        self.ends = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """One hash for each word, A-Z lower-cased."""
        return span_hashes(_LOWER[self.data], self.starts, self.ends)

    def text(self, word: int) -> bytes:
        """The bytes of one word, A-Z lower-cased."""
        return self.data[self.starts[word] : self.ends[word]].tobytes().lower()

    def shingles(self, size: int) -> list[np.ndarray]:
        """Sorted distinct hashes of ``size``-word shingles of each text.

        A text with fewer words has one shingle of all its words; one without words has none.
        """
        h = self.hashes()
        n = len(h) - size + 1
        if n > 0:
            windows = h[:n] * _FACTORS[0]
            for i in range(1, size):
                windows += h[i : n + i] * _FACTORS[i]
            windows = mixed(windows)
        out = []
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            if b - a >= size:
                out.append(np.unique(windows[a : b - size + 1]))
            elif b > a:
                out.append(mixed((h[a:b] * _FACTORS[: b - a]).sum(keepdims=True) + _FACTORS[size + b - a]))
            else:
                out.append(np.zeros(0, np.uint64))
        return out
