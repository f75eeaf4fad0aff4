"""Token ids of texts with a public byte-level BPE vocabulary.

Byte-level BPE never merges across the places where its pattern splits a text. A text is cut at
places that surely are such: before a single space, around a single line feed, and between a letter
and ASCII punctuation. The vocabulary's added tokens (``<|endoftext|>``) are pieces of their own, and
what stands between them is split like a text. The ids of each piece are kept by piece, so the
``tokenizers`` library encodes a piece about once per worker instead of at every mention.
``Encoder.encode`` equals encoding the whole text (tests compare them).
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from querymill.llm.words import first_bytes, span_hashes

NAME = "byte_bpe_50k.json"
#: Pieces kept by a worker, about 60 bytes each.
KEPT_PIECES = 1_500_000
#: UTF-8 of the white space beyond ASCII.
WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]

_SPACE = np.zeros(256, bool)
_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_WIDE = {n: np.array([int.from_bytes(w, "big") for w in WIDE_SPACES if len(w) == n], np.int64) for n in (2, 3)}
_encoders: dict[str, Encoder] = {}


def vocabulary(name: str = NAME) -> str:
    return public_tokenizers.path(name)


def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _spacelike(data: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """Whether white space stands right before (step -1) or after (step 1) the bytes ``at``."""
    n = len(data)
    byte = data[np.clip(at + step, 0, n - 1)]
    found = _SPACE[byte] | (at + step < 0) | (at + step >= n)
    wide = np.flatnonzero(byte >= 0x80)
    for size, codes in _WIDE.items():
        first = at[wide] - size if step < 0 else at[wide] + 1
        code = np.zeros(len(wide), np.int64)
        for i in range(size):
            code = code << 8 | data[np.clip(first + i, 0, n - 1)]
        found[wide] |= np.isin(code, codes)
    return found


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start: at texts' starts, and at places where the pattern always splits."""
    marks = np.zeros(len(data) + 1, bool)
    spaces = np.flatnonzero(data == 0x20)
    marks[spaces[~_spacelike(data, spaces, -1) & ~_spacelike(data, spaces, 1)]] = True
    lines = np.flatnonzero(data == 0x0A)
    alone = lines[~_spacelike(data, lines, -1) & ~_spacelike(data, lines, 1)]
    marks[alone] = marks[alone + 1] = True
    marks[1:-1] |= _LETTER[data[:-1]] & _PUNCTUATION[data[1:]]
    # A space or line feed at the end of a text is not between two characters of it.
    ends = offsets[1:][np.diff(offsets) > 0]
    for edge in (offsets[:-1][np.diff(offsets) > 0], ends - 1):
        marks[edge] &= ~_SPACE[data[edge]]
        inside = np.setdiff1d(edge + 1, ends)
        marks[inside] &= ~_SPACE[data[inside - 1]] | (data[inside] == 0x20)
    marks[offsets[:-1]] = True
    marks[len(data)] = False
    return np.flatnonzero(marks)


class Encoder:
    def __init__(self, path: str, kept: int = KEPT_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        added = list(self._tokenizer.get_added_tokens_decoder().values())
        names = sorted((t.content.encode() for t in added if t.content), key=len, reverse=True)
        self._added = re.compile(b"|".join(map(re.escape, names))) if names else None
        # Tokens that take white space with them or ask for word ends: their texts stay whole.
        self._plain = not any(t.lstrip or t.rstrip or t.single_word for t in added) and len({t.normalized for t in added}) < 2
        self._kept = kept
        self._forget()

    def _forget(self) -> None:
        size = 1 << (2 * self._kept - 1).bit_length()
        self._slots = np.full(size, -1, np.int32)
        self._n = 0
        self._keys = np.zeros((2, self._kept), np.uint64)
        self._at = np.zeros(self._kept + 1, np.int64)
        self._pool = np.zeros(4 * self._kept, np.uint16)

    def direct(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _added_spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of added tokens in texts, or of the whole texts that hold one."""
        spans = []
        if self._added is not None and self._added.search(data):
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                found = [m.span() for m in self._added.finditer(data, a, b)]
                spans += found if self._plain else [(a, b)] * bool(found)
        return tuple(np.array(spans, np.int64).reshape(-1, 2).T)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 without one."""
        out, slot, open_ = np.full(len(h), -1, np.int32), (h & np.uint64(len(self._slots) - 1)).astype(np.int64), np.arange(len(h))
        while len(open_):
            entry = self._slots[slot]
            hit = (entry >= 0) & (self._keys[0][entry] == h[open_])
            out[open_[hit]] = entry[hit]
            go = (entry >= 0) & ~hit
            open_, slot = open_[go], (slot[go] + 1) & (len(self._slots) - 1)
        return out

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, again: np.ndarray) -> None:
        raw = data.tobytes()
        ids = self.direct([raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        n, new = self._n, len(ids)
        at = self._at[n] + np.cumsum(sizes)
        if at[-1] > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros(max(len(self._pool), int(at[-1])), np.uint16)])
        self._pool[self._at[n] : at[-1]] = np.fromiter(chain.from_iterable(ids), np.uint16, int(sizes.sum()))
        self._at[n + 1 : n + new + 1] = at
        self._keys[0, n : n + new], self._keys[1, n : n + new] = keys, again
        self._n += new
        slot, entry = (keys & np.uint64(len(self._slots) - 1)).astype(np.int64), np.arange(n, n + new, dtype=np.int32)
        while len(entry):
            free = self._slots[slot] < 0
            self._slots[slot[free]] = entry[free]
            go = self._slots[slot] != entry
            slot, entry = (slot[go] + 1) & (len(self._slots) - 1), entry[go]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin; null is empty."""
        column = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        if offsets[-1] == offsets[0]:
            return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        filled = offsets[:-1] < offsets[1:]
        texts_at = np.append(offsets[:-1][filled], len(data))
        first, last = self._added_spans(data, texts_at)
        starts = cuts(data, np.unique(np.concatenate([texts_at, first, last])))
        if len(first):  # no piece starts inside an added token
            before = np.searchsorted(first, starts, "left")
            starts = starts[(before == 0) | (starts >= last[before - 1])]
        ends = np.append(starts[1:], len(data))
        keys, again = span_hashes(data, starts, ends), first_bytes(data, starts, ends)
        entry = self._find(keys)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            _, first = np.unique(keys[missing], return_index=True)
            first = missing[first]
            if self._n + len(first) > self._kept:
                self._forget()
                _, first = np.unique(keys, return_index=True)
                if len(first) > self._kept:
                    self._kept = 2 * len(first)
                    self._forget()
                missing = np.arange(len(keys))
            self._learn(data, starts[first], ends[first], keys[first], again[first])
            entry[missing] = self._find(keys[missing])
        assert (self._keys[1][entry] == again).all(), "two pieces share a hash"
        sizes = self._at[entry + 1] - self._at[entry]
        total = np.concatenate([[0], np.cumsum(sizes)])
        source = np.repeat(self._at[entry] - total[:-1], sizes) + np.arange(total[-1])
        return self._pool[source].astype(np.uint32), total[np.searchsorted(starts, offsets)]
