"""Ranked lexical search by exact inner products in sparse ball trees.

A document is a sparse vector of term weights, an item asks for the sum over its terms. Each task
builds ball trees over blocks of its documents: balanced splits along the line between two far
documents, then between the halves' centroids. A node has its centroid, the radius around it and, as
texts share few terms, the radius along each term. An item's score with any document of a node is at
most its product with the centroid plus its norm times the radius (Cauchy-Schwarz), and plus the sum
of the radii along its terms; the lesser of both, rounded upwards, is the bound. Items visit the nodes
of a block best first and stop at the first one that cannot reach their tenth best score; leaves are
scored in 64-bit integers. A search over some documents first gives all tasks scores to beat.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querymill.llm.words import _LOWER, NOT_ALNUM, Words, first_bytes, slices
from querymill.storage import store

TOP = 10
#: Items are looked for in blocks of so many bytes of text (a longer item makes a block alone), inside
#: a block by groups of so many items and terms.
ITEM_BYTES, ITEMS, TERMS = 4 << 20, 256, 1 << 15
#: Documents, and entries, of one tree; documents of a leaf; documents times terms of one tree.
BLOCK, ENTRIES, LEAF, CELLS = 4096, 2_000_000, 16, 1 << 24
#: Documents that are searched first, so that all tasks start with scores to beat.
PILOT = 1 << 14
#: Times that a split is drawn again along the line between the centroids of its halves.
REFINE = 3
_FILTER = (1 << 20) - 1


def _term_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    return words.hashes(), first_bytes(_LOWER[words.data], words.starts, words.ends)


@dataclass
class Vocabulary:
    """Distinct terms of a block of items: sorted hashes, and what confirms an equal hash."""

    hashes: np.ndarray
    checks: np.ndarray

    def __post_init__(self):
        self.maybe = np.zeros(_FILTER + 1, bool)
        self.maybe[(self.hashes & np.uint64(_FILTER)).astype(np.int64)] = True

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word position, term number) of the words that are terms."""
        hashes = words.hashes()
        at = np.flatnonzero(self.maybe[(hashes & np.uint64(_FILTER)).astype(np.int64)])
        if not len(at) or not len(self.hashes):
            return at[:0], at[:0]
        term = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        sure = self.hashes[term] == hashes[at]
        at, term = at[sure], term[sure]
        same = first_bytes(_LOWER[words.data], words.starts[at], words.ends[at]) == self.checks[term]
        return at[same], term[same]


@dataclass
class Items:
    """A block of items: their ids as text, and the numbers of their distinct terms."""

    ids: list[str]
    terms: list[np.ndarray]
    vocabulary: Vocabulary


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """Items with an id and a term, a bounded amount of text at a time."""
    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    ids: list[str] = []
    found: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def block() -> Items:
        hashes, where = np.unique(np.concatenate([h for h, _ in found]), return_index=True)
        checks = np.concatenate([c for _, c in found])[where]
        return Items(list(ids), [np.unique(np.searchsorted(hashes, h)) for h, _ in found], Vocabulary(hashes, checks))

    for row in rows.where("id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        words = Words(pa.array([row["text"]]), NOT_ALNUM)
        if not len(words.starts):
            continue
        if ids and size + len(words.data) > ITEM_BYTES:
            yield block()
            ids, found, size = [], [], 0
        ids.append(row["id"])
        found.append(_term_hashes(words))
        size += len(words.data)
    if ids:
        yield block()


def vectors(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """Per document: doc_id, n (terms with repeats), and its vocabulary terms with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                words = Words(part.column(1), NOT_ALNUM)
                at, term = vocabulary.find(words)
                width = max(len(vocabulary.hashes), 1)
                doc = np.searchsorted(words.first, at, "right") - 1
                code, tf = np.unique(doc * width + term, return_counts=True)
                edges = np.searchsorted(code, np.arange(len(words) + 1) * width)
                terms, tf = (code % width).astype(np.int32), tf.astype(np.int32)
                pairs = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
                columns = [pa.array([x[a:b].tobytes() for a, b in pairs], pa.binary()) for x in (terms, tf)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.counts), *columns], names=["doc_id", "n", "terms", "counts"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(count, "doc_id long, n long, terms binary, counts binary")


def _held(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(width, np.int64)
    for batch in batches:
        for x in batch.column(0).to_pylist():
            total[np.frombuffer(x, np.int32)] += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])


def document_frequencies(found: DataFrame, width: int) -> np.ndarray:
    """Documents of each term; one row per task and term is shuffled."""
    counted = found.select("terms").mapInArrow(lambda batches: _held(batches, width), "term long, df long")
    out = np.zeros(width, np.int64)
    for row in counted.groupBy("term").agg(F.sum("df").alias("df")).collect():  # terms of one block of items
        out[row["term"]] = row["df"]
    return out


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)


class Block:
    """Documents of one tree as entries (document, term, integer weight), by document."""

    def __init__(self, ids: np.ndarray, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        self.ids, self.docs, self.terms, self.impacts = ids, docs, terms, impacts


class BallTree:
    """A balanced tree over a block; nodes are numbered as in a heap, levels are contiguous ranges."""

    def __init__(self, block: Block, weights: np.ndarray, width: int):
        n = len(block.ids)
        root = np.sqrt(weights.astype(np.float64))
        docs, terms, y = block.docs, block.terms, block.impacts * root[block.terms]
        squares = np.bincount(docs, y * y, minlength=n)
        order, bounds, self.levels = np.arange(n), np.array([0, n]), [np.array([0, n])]
        while np.diff(bounds).max() > LEAF:
            node = np.empty(n, np.int64)
            node[order] = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))

            def to(pivots: np.ndarray) -> np.ndarray:
                """Each document's product with the pivot of its node."""
                dense = np.zeros((len(pivots), width))
                at = np.full(n, -1)
                at[pivots] = np.arange(len(pivots))
                own = at[docs] >= 0
                dense[at[docs[own]], terms[own]] = y[own]
                return np.bincount(docs, y * dense[node[docs], terms], minlength=n)

            def farthest(pivots: np.ndarray, products: np.ndarray) -> np.ndarray:
                away = squares + squares[pivots][node] - 2 * products
                by = np.lexsort((np.arange(n), -away, node))
                return by[bounds[:-1]]

            start = order[bounds[:-1]]
            first = farthest(start, to(start))
            to_first = to(first)
            second = farthest(first, to_first)
            order = np.lexsort((np.arange(n), to_first - to(second), node))
            middle = (bounds[:-1] + bounds[1:] + 1) // 2
            for _ in range(REFINE):  # the line between the halves' centroids parts them better
                share = np.empty(n)
                share[order] = np.repeat(np.stack([1 / np.maximum(middle - bounds[:-1], 1), -1 / np.maximum(bounds[1:] - middle, 1)], 1).ravel(), np.stack([middle - bounds[:-1], bounds[1:] - middle], 1).ravel())
                at = node[docs] * width + terms
                line = np.bincount(at, y * share[docs], minlength=(len(bounds) - 1) * width)
                order = np.lexsort((np.arange(n), np.bincount(docs, y * line[at], minlength=n), node))
            bounds = np.concatenate([np.stack([bounds[:-1], middle], 1).ravel(), bounds[-1:]])
            self.levels.append(bounds)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        by = np.argsort(place[docs], kind="stable")
        self.ids = block.ids[order]
        self.docs, self.terms, self.impacts = place[docs][by], terms[by], block.impacts[by]
        self.y, self.squares, self.width, self.weights = y[by], squares[order], width, weights
        self.starts = np.searchsorted(self.docs, np.arange(n + 1))

    def bounds(self, asked: np.ndarray) -> np.ndarray:
        """Upper bounds of every item (row of ``asked``: its terms) with every node."""
        root = np.sqrt(self.weights.astype(np.float64))
        query = asked * root
        length = np.sqrt(asked @ self.weights)
        out: list[np.ndarray] = []
        for bounds in self.levels:
            nodes, sizes = len(bounds) - 1, np.diff(bounds)
            node = np.repeat(np.arange(nodes), sizes)
            at = node[self.docs] * self.width + self.terms
            cells = nodes * self.width
            centroid = np.bincount(at, self.y, minlength=cells) / np.maximum(np.repeat(sizes, self.width), 1)
            # the ball: distances to the centroid, more than rounding can take
            norms = (centroid * centroid).reshape(nodes, -1).sum(1)[node]
            away = self.squares - 2 * np.bincount(self.docs, self.y * centroid[at], minlength=len(self.ids)) + norms
            radius = np.sqrt(np.maximum.reduceat(np.maximum(away, 0) + 1e-10 * (self.squares + norms), bounds[:-1]))
            # the same along each term; a document without the term lies the centroid's own value away
            most = np.zeros(cells)
            np.maximum.at(most, at, self.y)
            along = np.maximum(most - centroid, 0)
            centroid, along = centroid.reshape(nodes, -1), along.reshape(nodes, -1)
            middle = query @ centroid.T
            upper = np.minimum(middle + length[:, None] * radius, middle + query @ along.T) * (1 + 1e-9) + 1
            out.append(upper if not out else np.minimum(upper, np.repeat(out[-1], 2, axis=1)))
        return np.concatenate(out, axis=1)

    def scores(self, leaf: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a leaf's documents, and their exact scores with items."""
        a, b = self.levels[-1][leaf : leaf + 2]
        x, y = self.starts[a], self.starts[b]
        if x == y:
            return self.ids[a:b], np.zeros((len(asked), b - a), np.int64)
        entries = self.impacts[x:y] * self.weights[self.terms[x:y]] * asked[:, self.terms[x:y]]
        full = np.flatnonzero(np.diff(self.starts[a : b + 1]))
        out = np.zeros((len(asked), b - a), np.int64)
        out[:, full] = np.add.reduceat(entries, self.starts[a:b][full] - x, axis=1)
        return self.ids[a:b], out


class Search:
    """The best documents of each item of a group, over the blocks that it is shown."""

    def __init__(self, asked: np.ndarray, weights: np.ndarray, top: int, floor: np.ndarray | None = None):
        self.asked, self.weights, self.top = asked, weights, top
        self.floor = np.ones(len(asked), np.int64) if floor is None else np.maximum(floor, 1)
        self.scores = np.zeros((len(asked), top), np.int64)
        self.ids = np.full((len(asked), top), np.iinfo(np.int64).max)
        self.leaves = self.visited = 0

    def need(self) -> np.ndarray:
        """The least score that can still be among the best of each item."""
        return np.maximum(self.scores[:, -1], self.floor)

    def add(self, block: Block) -> None:
        n, most = len(block.ids), max(64, CELLS // self.asked.shape[1])
        for first in range(0, n, most):
            a, b = np.searchsorted(block.docs, [first, first + most])
            self._add(Block(block.ids[first : first + most], block.docs[a:b] - first, block.terms[a:b], block.impacts[a:b]))

    def _add(self, block: Block) -> None:
        tree = BallTree(block, self.weights, self.asked.shape[1])
        upper, inner = tree.bounds(self.asked), (1 << (len(tree.levels) - 1)) - 1
        front = np.full(upper.shape, -np.inf)
        front[:, 0] = upper[:, 0]
        items = np.arange(len(self.asked))
        self.leaves += (upper.shape[1] - inner) * len(items)
        while True:
            best = front.argmax(1)
            live = items[front[items, best] >= self.need()]
            if not len(live):
                return
            node = best[live]
            front[live, node] = -np.inf
            split = node < inner
            for child in (1, 2):
                front[live[split], 2 * node[split] + child] = upper[live[split], 2 * node[split] + child]
            for leaf in np.unique(node[~split]).tolist():
                # all items that may still need the leaf, so that it is scored once
                need = np.flatnonzero(upper[:, leaf] >= self.need())
                front[need, leaf] = upper[need, leaf] = -np.inf
                self.visited += len(need)
                self._rank(need, *tree.scores(leaf - inner, self.asked[need]))

    def _rank(self, need: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        better = scores.max(1) >= self.need()[need]
        need, scores = need[better], scores[better]
        s = np.concatenate([self.scores[need], scores], 1)
        i = np.concatenate([self.ids[need], np.broadcast_to(ids, scores.shape)], 1)
        order = np.lexsort((i, -s), axis=1)[:, : self.top]
        self.scores[need] = np.take_along_axis(s, order, 1)
        self.ids[need] = np.take_along_axis(i, order, 1)


def _groups(items: Items, weights: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Items of a block, a bounded number of items and terms at a time."""
    first, terms, size = 0, [], 0
    for own in items.terms:
        own = own[weights[own] > 0]
        if terms and (len(terms) >= ITEMS or size + len(own) > TERMS):
            yield first, terms
            first, terms, size = first + len(terms), [], 0
        terms.append(own)
        size += len(own)
    yield first, terms


def _blocks(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int) -> Iterator[Block]:
    """Documents with terms, so many at a time as make a tree."""

    def block() -> Block:
        sizes = [len(t) for _, _, t, _ in held]
        docs = np.repeat(np.arange(len(held)), sizes)
        n = np.array([x[1] for x in held], np.int64)
        m = 10 + (90 * n * n_docs) // n_terms
        terms = np.concatenate([t for _, _, t, _ in held]).astype(np.int64)
        tf = np.concatenate([c for _, _, _, c in held]).astype(np.int64)
        impacts = (1_000_000_000 * tf) // (1000 * tf + 8 * m[docs])
        return Block(np.array([x[0] for x in held], np.int64), docs, terms, impacts)

    held: list[tuple] = []
    entries = 0
    for batch in batches:
        for ident, n, terms, counts in zip(*[c.to_pylist() for c in batch.columns]):
            held.append((ident, n, np.frombuffer(terms, np.int32), np.frombuffer(counts, np.int32)))
            entries += len(held[-1][2])
            if len(held) == BLOCK or entries >= ENTRIES:
                yield block()
                held, entries = [], 0
    if held:
        yield block()


def _part(block: Block, known: np.ndarray) -> Block | None:
    """The documents of a block that have terms of a group, with those terms numbered anew."""
    at = np.searchsorted(known, block.terms)
    own = known[np.minimum(at, len(known) - 1)] == block.terms if len(known) else np.zeros(len(at), bool)
    docs, renumbered = np.unique(block.docs[own], return_inverse=True)
    return Block(block.ids[docs], renumbered, at[own], block.impacts[own]) if len(docs) else None


def search(
    docs: DataFrame,
    items: DataFrame,
    *,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The ``top`` best documents of each item with scores above 0, equal scores by smaller id.

    Terms are runs of ASCII letters and digits and of other characters beyond ASCII, A-Z lower-cased.
    N counts the documents that have terms, L their terms; a document of n terms has
    ``m = 10 + 90 * n * N div L`` and scores ``w * (10**9 * tf div (1000 * tf + 8 * m))`` for each
    distinct term of the item, ``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``.

    Null and empty texts have no terms; such documents and items are never found and find nothing.
    Documents without id count in N, L and df and are not returned; items without id are left out.
    Rows that share an id count each. Empty tables give no rows, other columns are ignored. Document
    ids are cast to long. Columns: the item's id, rank, doc_id, score.
    """
    spark = docs.sparkSession
    kind = items.schema[item_id_col].dataType
    schema = "g long, item string, doc_id long, score long"
    results: list[DataFrame] = []
    for items_block in item_blocks(items, item_id_col, item_text_col):
        found = store(vectors(docs, items_block.vocabulary, id_col, text_col), "vectors")
        n_docs, n_terms = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = term_weights(document_frequencies(found, len(items_block.vocabulary.hashes)), n_docs)

        def look(batches: Iterator[pa.RecordBatch], floors: np.ndarray, block=items_block, weights=weights, n_docs=n_docs, n_terms=n_terms) -> Iterator[pa.RecordBatch]:
            searches = []
            for first, terms in _groups(block, weights):
                known = np.unique(np.concatenate(terms))
                asked = np.zeros((len(terms), max(len(known), 1)), bool)
                for i, own in enumerate(terms):
                    asked[i, np.searchsorted(known, own)] = True
                own_weights = weights[known] if len(known) else np.zeros(1, np.int64)
                searches.append((first, known, Search(asked, own_weights, top, floors[first : first + len(terms)])))
            for documents in _blocks(batches, n_docs, n_terms):
                for _, known, each in searches:
                    if part := _part(documents, known):
                        each.add(part)
            for first, _, each in searches:
                at, place = np.nonzero(each.scores)
                names = pa.array([block.ids[first + i] for i in at.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(at + first), names, pa.array(each.ids[at, place]), pa.array(each.scores[at, place])], names=["g", "item", "doc_id", "score"])

        def ranked(rows: DataFrame, floors: np.ndarray, look=look) -> DataFrame:
            best = rows.mapInArrow(lambda batches: look(batches, floors), schema)
            order = Window.partitionBy("g").orderBy(F.desc("score"), "doc_id")
            return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

        usable = found.where("doc_id IS NOT NULL AND octet_length(terms) > 0")
        floors = np.zeros(len(items_block.ids), np.int64)
        if n_docs > 2 * PILOT:
            some = usable.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(n_docs // PILOT)) == 0)
            for row in ranked(some, floors).where(F.col("rank") == top).collect():  # one row for each item of the block
                floors[row["g"]] = row["score"]
        ranked_rows = ranked(usable, floors)
        results.append(ranked_rows.select(F.col("item").cast(kind).alias(item_id_col), "rank", "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], schema).select(F.col("item").cast(kind).alias(item_id_col), F.lit(0).alias("rank"), "doc_id", "score")
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    return whole
