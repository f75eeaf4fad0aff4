"""Benchmark decontamination with a generalised suffix automaton over the items' words.

The automaton holds every run of words of all items. Training words are streamed through it, which
gives the longest match ending at each word; where that reaches a window (ten words, or a whole
shorter item), the window's words are hit and its items noted. Words are compared through hashes
first: only stretches whose neighbouring words all stand next to each other in some item are worth
streaming, and in them words are compared as bytes.

Items are cut into overlapping pieces of bounded size and go to automata of at most
``AUTOMATON_BYTES`` of text. Each is broadcast, one after the other; a usual benchmark needs one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.llm.words import NOT_ALNUM, Words, slices
from querymill.storage import store

AUTOMATON_BYTES = 2_000_000
PIECE_WORDS = 4_096
_SEPARATE = bytes(0x20 if i in NOT_ALNUM else i + 32 if 65 <= i <= 90 else i for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text."""
    return (text or "").encode().translate(_SEPARATE).split()


class Automaton:
    """Generalised suffix automaton of word sequences, each with an item name."""

    def __init__(self, sequences: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, str, int]] = []
        pairs = set()
        for item, words in sequences:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            pairs.update(zip(ids, ids[1:]))
            state = 0
            for n, w in enumerate(ids, 1):
                state = self._extend(state, w)
                if n >= window or n == len(ids):
                    ends.append((state, item, min(n, window)))
        self.shortest = min((n for _, _, n in ends), default=window)
        #: Items by the state that holds one of their windows, and the windows' length.
        self.items: dict[int, dict[int, set[str]]] = {}
        for state, item, n in ends:
            self.items.setdefault(self._holder(state, n), {}).setdefault(n, set()).add(item)
        self.chain = [-1] * len(self.link)  # nearest state up the links, itself included, with items
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.chain[s] = s if s in self.items else self.chain[self.link[s]] if s else -1
        # For the search by hashes.
        names = pa.array([w.decode() for w in self.vocabulary] or [""])
        hashes = Words(names, b"").hashes()
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        n = len(self.vocabulary)
        self.pairs = np.sort(np.array([a * n + b for a, b in pairs], np.int64))

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(moves)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _holder(self, state: int, n: int) -> int:
        """The state that holds the last ``n`` words of ``state``."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def stream(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """Windows in a stretch of words: (first word, one past the last, items)."""
        state = matched = 0
        for i, word in enumerate(words):
            w = self.vocabulary.get(word, -1)
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                matched += 1
            if matched < self.shortest:
                continue
            holder = self.chain[state]
            while holder >= 0:
                for n, items in self.items[holder].items():
                    if n <= matched:
                        yield i + 1 - n, i + 1, items
                holder = self.chain[self.link[holder]]

    def stretches(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last words of stretches that may hold a window, within one text each."""
        h = words.hashes()
        if not len(h) or not self.vocabulary:
            return np.zeros(0, int), np.zeros(0, int)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        ids = np.where(self.hashes[at] == h, self.ids[at], -1)
        if self.shortest < 2:
            good, tail = ids >= 0, 0
        else:
            known = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            codes = ids[known] * len(self.vocabulary) + ids[known + 1]
            place = np.minimum(np.searchsorted(self.pairs, codes), max(0, len(self.pairs) - 1))
            good, tail = np.zeros(len(h), bool), 1
            good[known] = self.pairs[place] == codes if len(self.pairs) else False
        ends_text = words.first[1:] - 1  # the last word of a text has no neighbour in it
        breaks = np.zeros(len(h) + 1, bool)
        breaks[words.first[1:][words.first[1:] < len(h)]] = True
        if tail:
            good[ends_text[ends_text >= 0]] = False
        first = np.flatnonzero(good & (~np.concatenate([[False], good[:-1]]) | breaks[:-1]))
        last = np.flatnonzero(good & (~np.concatenate([good[1:], [False]]) | breaks[1:]))
        long = last + tail + 1 - first >= self.shortest
        return first[long], last[long] + tail + 1


def _cut_items(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Items as pieces of bounded size that overlap by a window less one word."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                for a in range(0, max(1, len(words) - window + 1) if words else 0, PIECE_WORDS):
                    rows.append((item, b" ".join(words[a : a + PIECE_WORDS + window - 1]).decode()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["item", "words"])

    named = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    return named.mapInArrow(cut, "item string, words string")


def automata(items: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text") -> Iterator[Automaton]:
    """Automata over all items, each of about ``AUTOMATON_BYTES`` of words."""
    cut = _cut_items(items, window, id_col, text_col)
    total = cut.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n = -(-total // AUTOMATON_BYTES) or 1
    if n > 1:
        cut = store(cut.withColumn("shard", F.pmod(F.xxhash64("item", "words"), F.lit(n))), "items")
    for shard in range(n):
        rows = (cut.where(F.col("shard") == shard) if n > 1 else cut).select("item", "words").distinct()
        yield Automaton([(r["item"], r["words"].encode().split()) for r in rows.collect()], window)


def _match(words: Words, automaton: Automaton, hit: np.ndarray, items: dict[int, set[str]]) -> None:
    """Mark hit words of a slice and add the items of each text."""
    for a, b in zip(*automaton.stretches(words)):
        own: set[str] | None = None
        for x, y, found in automaton.stream([words.text(w) for w in range(a, b)]):
            hit[a + x : a + y] = True
            if own is None:
                own = items.setdefault(int(np.searchsorted(words.first, a, "right")) - 1, set())
            own |= found


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def scan(
    docs: DataFrame,
    items: DataFrame,
    *,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Hit words and items of every document; no shuffle of documents.

    Columns: the id, n_words, n_hit, spans (hit stretches as word positions, end exclusive) and
    items (sorted as strings). A null or empty text has no words. Items without id or words are no
    items. Repeated documents are scanned each, repeated items count once per item id; other
    columns are ignored. Without items nothing is hit.
    """
    out = docs.select(F.col(id_col), F.col(text_col).alias("_text"), F.lit(None).cast("array<int>").alias("_spans"), F.lit(None).cast("array<string>").alias("_items"))
    kinds = {f.name: f.dataType.simpleString() for f in out.schema.fields}
    built = automata(items, window, item_id_col, item_text_col)
    automaton = next(built)
    while automaton is not None:
        following = next(built, None)
        done = following is None

        def search(batches: Iterator[pa.RecordBatch], automaton=automaton, done=done) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 1):
                    words = Words(part.column(1), NOT_ALNUM)
                    hit = np.zeros(len(words.starts), bool)
                    before = part.column(3).to_pylist()
                    found = {i: set(x) for i, x in enumerate(before) if x}
                    for i, spans in enumerate(part.column(2).to_pylist()):
                        for a, b in zip(*[iter(spans or ())] * 2):
                            hit[words.first[i] + a : words.first[i] + b] = True
                    _match(words, automaton, hit, found)
                    spans: list[list[int]] = [[] for _ in before]
                    counts = np.diff(np.concatenate([[0], np.cumsum(hit)])[words.first])
                    for i in found:
                        a, b = _runs(hit[words.first[i] : words.first[i + 1]])
                        spans[i] = np.stack([a, b], 1).ravel().tolist()
                    names = [sorted(found.get(i, ())) for i in range(len(before))]
                    spans_col, items_col = pa.array(spans, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))
                    if done:
                        columns = [part.column(0), pa.array(words.counts), pa.array(counts), spans_col, items_col]
                        yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "n_hit", "spans", "items"])
                    else:
                        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), spans_col, items_col], names=list(kinds))

        if done:
            return out.mapInArrow(search, f"`{id_col}` {kinds[id_col]}, n_words long, n_hit long, spans array<int>, items array<string>")
        out = store(out.mapInArrow(search, ", ".join(f"`{n}` {k}" for n, k in kinds.items())), "scanned")
        automaton = following


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and the checksum of the items of each scanned document."""
    return scanned.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def cut_text(text: str, automaton_list: list[Automaton], max_share: float) -> tuple[str | None, bool]:
    """The text without hit stretches, or None when they cover more than ``max_share`` of its words.

    Cutting can bring words together that make up a new window, so it is repeated until none is left.
    """
    n_first, removed, changed = None, 0, False
    while True:
        words = Words(pa.array([text]), NOT_ALNUM)
        n_first = len(words.starts) if n_first is None else n_first
        hit = np.zeros(len(words.starts), bool)
        for automaton in automaton_list:
            _match(words, automaton, hit, {})
        if not hit.any():
            return text, changed
        removed, changed = removed + int(hit.sum()), True
        if removed > max_share * n_first:
            return None, True
        data, kept, at = text.encode(), [], 0
        for a, b in zip(*_runs(hit)):
            kept.append(data[at : words.starts[a]])
            at = words.ends[b - 1]
        text = b"".join([*kept, data[at:]]).decode()


def clean(
    docs: DataFrame,
    items: DataFrame,
    *,
    window: int = 10,
    max_share: float = 0.5,
    text_col: str = "text",
    chars_col: str | None = "n_chars",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Documents with all columns, without the stretches that match benchmark windows.

    A document of which more than ``max_share`` of the words match goes. Texts without a match stay
    as they are, null texts too; ``chars_col``, if there, follows the new length. The number of
    automata changes nothing: with several, every round of cuts takes the hits of all of them.
    """
    schema = docs.schema
    text, chars = schema.names.index(text_col), schema.names.index(chars_col) if chars_col in schema.names else None
    built = automata(items, window, item_id_col, item_text_col)
    automaton = next(built)
    if next(built, None) is not None:
        built.close()
        return _clean_in_rounds(docs, items, text, chars, window, max_share, item_id_col, item_text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                words = Words(part.column(text), NOT_ALNUM)
                found: dict[int, set[str]] = {}
                _match(words, automaton, np.zeros(len(words.starts), bool), found)
                if not found:
                    yield part
                    continue
                texts, keep = part.column(text).to_pylist(), np.ones(part.num_rows, bool)
                for i in found:
                    texts[i], _ = cut_text(texts[i], [automaton], max_share)
                    keep[i] = texts[i] is not None
                columns = list(part.columns)
                columns[text] = pa.array(texts, columns[text].type)
                if chars is not None:
                    changed = pa.array([i in found for i in range(part.num_rows)])
                    columns[chars] = pc.if_else(changed, pc.utf8_length(columns[text]).cast(columns[chars].type), columns[chars])
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(keep))

    return docs.mapInArrow(cut, schema)


def _clean_in_rounds(docs: DataFrame, items: DataFrame, text: int, chars: int | None, window: int, max_share: float, item_id_col: str, item_text_col: str) -> DataFrame:
    """``clean`` with several automata, as ``cut_text`` does it with a list of them.

    A round scans with all automata, cuts the union of their hits and judges what all rounds removed
    by the words of the first; what a round changed goes to the next, until nothing is hit.
    """
    numbered = docs.select("*", F.monotonically_increasing_id().alias("_row"), F.lit(None).cast("long").alias("_first"), F.lit(0).cast("long").alias("_removed"))
    left, done = store(numbered, "uncut"), []
    schema, text_col = left.schema, docs.columns[text]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                words = Words(part.column(text), NOT_ALNUM)
                texts = []
                for i, spans in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    kept, at = [], words.offsets[i]
                    for a, b in zip(*[iter(spans)] * 2):
                        kept.append(words.data[at : words.starts[words.first[i] + a]].tobytes())
                        at = words.ends[words.first[i] + b - 1]
                    texts.append(b"".join([*kept, words.data[at : words.offsets[i + 1]].tobytes()]).decode())
                columns = list(part.columns[:-1])
                columns[text] = pa.array(texts, columns[text].type)
                if chars is not None:
                    columns[chars] = pc.utf8_length(columns[text]).cast(columns[chars].type)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    while True:
        scanned = scan(left, items, window=window, id_col="_row", text_col=text_col, item_id_col=item_id_col, item_text_col=item_text_col)
        hits = store(scanned.where("n_hit > 0").select("_row", "n_words", "n_hit", "spans"), "hits")
        if hits.isEmpty():
            break
        done.append(left.join(hits.select("_row").hint("merge"), "_row", "left_anti").select(schema.names))
        own = [left[f"`{c}`"] for c in docs.columns]
        first, removed = F.coalesce(left["_first"], hits["n_words"]), left["_removed"] + hits["n_hit"]
        hit = left.join(hits.hint("merge"), left["_row"] == hits["_row"]).where(removed <= max_share * first)
        left = store(hit.select(*own, left["_row"], first.alias("_first"), removed.alias("_removed"), hits["spans"].alias("_spans")).mapInArrow(cut, schema), "cut")
    out = left
    for part in done:
        out = out.unionByName(part)
    return out.select([F.col(f"`{c}`") for c in docs.columns])
