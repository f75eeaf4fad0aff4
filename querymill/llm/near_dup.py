"""Near duplicates by SetSketch registers, bands of them, joint estimation and verification.

A document's set of word shingles becomes ``REGISTERS`` registers. A register holds the exponent of
the smallest of the set's exponentially distributed hashes, truncated to 16 bits; sketches merge by
maximum. Equal bands of registers make candidates, the likelihood of the registers that are larger,
smaller and equal estimates a pair's similarity, and what remains is confirmed on the full sets.

Texts with equal sets are one class, worked on through its smallest id. Large buckets never yield all
their pairs: members first meet the most central one, and buckets whose members are then connected are
done. Members with so many shingles of their own that no partner in the bucket can be similar enough
leave it. Members of buckets that are still open are then compared by an exact filter: a similar pair
shares one of the rarest shingles of either, and only unconnected pairs that do are tested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.llm.words import Words, mixed, slices
from querymill.storage import store

SHINGLE = 5
SIMILARITY_PERCENT = 75
#: 32 bands of 4: a pair of similarity 0.75 shares a band with a chance of 1 - 5e-6.
BANDS, BAND = 32, 4
REGISTERS = BANDS * BAND
#: Base of the exponents and rate of the hashes.
BASE, RATE, TOP = 1.001, 20.0, 65_534
#: Pairs estimated below are not confirmed; for a pair of 0.75 that is six standard deviations off.
ESTIMATE = 0.5

_FACTORS = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SALTS = mixed(np.arange(1001, 1001 + REGISTERS, dtype=np.uint64))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (uint16) of each set; zeros for an empty set."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    filled = [i for i, s in enumerate(sets) if len(s)]
    if not filled:
        return out
    values = np.concatenate([sets[i] for i in filled])
    starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in filled])[:-1]])
    least = np.empty((len(filled), REGISTERS), np.uint64)
    for r in range(REGISTERS):
        least[:, r] = np.minimum.reduceat(values * _FACTORS[r] + _SALTS[r], starts)
    smallest = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    out[filled] = np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, TOP + 1)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs of sketches (rows) of sets of known sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    most = np.minimum(u / (1 - u), (1 - u) / u)
    j = most * np.linspace(0, 1, 101)[None, :]
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = chance(u - (1 - u) * j), chance((1 - u) - u * j)
    log = lambda p: np.log(np.clip(p, 1e-12, 1))
    likelihood = more[:, None] * log(up) + less[:, None] * log(down) + same[:, None] * log(1 - up - down)
    return j[np.arange(len(j)), likelihood.argmax(1)]


def _sketches(docs: DataFrame, with_set: bool) -> DataFrame:
    """Of rows (id, text): id, n, two hashes of the set, registers, and the set if asked for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = Words(part.column(1)).shingles(SHINGLE)
                found = registers(sets)
                n = np.array([len(s) for s in sets], np.int64)
                keys = [[int(mixed(s ^ salt).sum(dtype=np.uint64).astype(np.int64)) for s in sets] for salt in _SALTS[:2]]
                columns = [part.column(0), pa.array(n), *map(pa.array, keys), pa.array([r.tobytes() for r in found], pa.binary())]
                names = ["node", "n", "k1", "k2", "sketch"]
                if with_set:
                    columns, names = [*columns, pa.array([s.tobytes() for s in sets], pa.binary())], [*names, "shingles"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "node long, n long, k1 long, k2 long, sketch binary" + ", shingles binary" * with_set
    return docs.mapInArrow(work, schema)


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (node, n, sketch): a row (key, node, n) for each band."""
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part = batch.slice(start, 2000)
            found = np.frombuffer(b"".join(part.column(2).to_pylist()), "<u8").reshape(-1, BANDS)
            keys = mixed(found ^ _SALTS[:BANDS][None, :])
            node, n = (np.repeat(np.asarray(part.column(i)), BANDS) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node), pa.array(n)], names=["key", "node", "n"])


def _each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (node, shingles): a row (shingle, node) for each shingle."""
    for batch in batches:
        for node, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            shingles = np.frombuffer(packed.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shingles), pa.array(np.full(len(shingles), node))], names=["shingle", "node"])


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sketch_a", "sketch_b"))
        n_a, n_b = (np.asarray(batch.column(c)).astype(float) for c in ("n_a", "n_b"))
        if len(a):
            likely = similarity(a, b, n_a, n_b) >= ESTIMATE
            yield batch.select(["a", "b"]).filter(pa.array(likely))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b")):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            x, y = (x, y) if len(x) <= len(y) else (y, x)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int((y[at] == x).sum())
            keep.append(100 * both >= SIMILARITY_PERCENT * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


class _Graph:
    """Nodes of shared buckets: their sketches and sets, and which are connected so far."""

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes
        self.labels = store(nodes.select("node", F.col("node").alias("label")).distinct(), "labels")

    def test(self, pairs: DataFrame) -> None:
        """Test pairs (a < b) and connect what is linked."""
        linked = store(pairs.select("a", "b").distinct(), "pairs")
        if linked.isEmpty():
            return
        for what, check in (("sketch", _estimated), ("shingles", _confirmed)):
            short = {"sketch": "sketch", "shingles": "set"}[what]
            for side in ("a", "b"):
                own = self.nodes.select(F.col("node").alias(side), F.col(what).alias(f"{short}_{side}"), F.col("n").alias(f"n_{side}"))
                linked = linked.hint("merge").join(own, side)
            linked = store(linked.mapInArrow(check, "a long, b long"), "linked")
            if linked.isEmpty():
                return
        self.connect(linked)

    def connect(self, links: DataFrame) -> None:
        """Merge labels along links: each label takes its smallest neighbour until none differs."""
        one, two = (self.labels.select(F.col("node").alias(s), F.col("label").alias(f"l{s}")) for s in ("a", "b"))
        edges = links.join(one, "a").join(two, "b").where("la <> lb").select(F.col("la").alias("u"), F.col("lb").alias("v")).distinct()
        edges = store(edges, "edges")
        while not edges.isEmpty():
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            parents = store(both.groupBy("u").agg(F.least("u", F.min("v")).alias("p")), "parents")
            moved = self.labels.join(parents, self.labels.label == parents.u, "left")
            self.labels = store(moved.select("node", F.coalesce("p", "label").alias("label")), "labels")
            up = edges.join(parents.withColumnRenamed("p", "pu"), "u").join(parents.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
            edges = store(up.where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), "edges")

    def open(self, buckets: DataFrame) -> DataFrame:
        """Buckets (key, node, n) whose members are not all connected, with label and size; stored."""
        labelled = store(buckets.select("key", "node", "n").hint("merge").join(self.labels, "node"), "labelled")
        sizes = labelled.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("x"), F.max("label").alias("y"))
        sizes = store(sizes.where("x < y").select("key", "size"), "open-keys")
        return store(labelled.hint("merge").join(sizes, "key"), "open")

    def prune(self, opened: DataFrame) -> DataFrame:
        """Rows (key, node, n) of members that can still have a partner in their bucket.

        A partner lies in some open bucket. Shingles that no other member of any open bucket has
        cannot be common, so with ``o`` others the similarity is at most ``o / (n + m - o)``, where
        ``m`` is the larger of ``o`` and the smallest size in the bucket.
        """
        members = store(opened.select("node").distinct(), "members")
        each = self.nodes.select("node", "shingles").join(members, "node", "left_semi").mapInArrow(_each_shingle, "shingle long, node long")
        holders = each.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last"))
        own = store(holders.where("node = last").groupBy("node").agg(F.count("*").alias("own")), "own-shingles")
        least = store(opened.groupBy("key").agg(F.min("n").alias("least")), "least")
        known = opened.hint("merge").join(own, "node", "left").withColumn("o", F.col("n") - F.coalesce("own", F.lit(0)))
        bound = F.col("n") + F.greatest("least", "o") - F.col("o")
        known = store(known.select("key", "node", "n", "o"), "known")
        return known.hint("merge").join(least, "key").where(100 * F.col("o") >= SIMILARITY_PERCENT * bound).select("key", "node", "n")


def _ordered(left: str = "p", right: str = "node") -> list:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def _rare_shingles(graph: _Graph, opened: DataFrame) -> DataFrame:
    """Rows (shingle, node, n, place) of the rarest shingles of open buckets' members; stored.

    ``|x & y| >= a`` makes the first ``|x| - a + 1`` shingles of x, rarest first, meet those of y.
    At 0.75, ``a`` is at least 3/7 of both sizes, and no partner is smaller than three quarters, or
    than the smallest member of the buckets. ``place`` counts from 1.
    """
    smallest = store(opened.groupBy("key").agg(F.min("n").alias("least")), "smallest")
    sized = opened.hint("merge").join(smallest, "key").groupBy("node").agg(F.first("n").alias("n"), F.min("least").alias("least"))
    members = store(sized, "members")
    each = graph.nodes.select("node", "shingles").join(members.select("node"), "node", "left_semi").mapInArrow(_each_shingle, "shingle long, node long")
    each = store(each, "shingles")
    common = store(each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "common")
    lists = each.hint("merge").join(common, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("ranked"))
    partner = F.greatest("least", F.ceil(F.col("n") * SIMILARITY_PERCENT / 100))
    own = F.col("n") - F.size("ranked")
    length = F.greatest(F.col("n") - _needed(F.col("n"), partner) + 1 - own, F.lit(0)).cast("int")
    first = lists.join(members, "node").select("node", "n", own.alias("own"), F.posexplode(F.slice("ranked", 1, length)).alias("at", "r"))
    return store(first.select("r.shingle", "node", "n", (F.col("own") + F.col("at") + 1).alias("place")), "rare")


def _needed(n: Column, m: Column) -> Column:
    """Common shingles that a similar pair of these sizes has at least."""
    return F.ceil(SIMILARITY_PERCENT * (n + m) / (100 + SIMILARITY_PERCENT))


def _mixed(graph: _Graph, rows: DataFrame) -> DataFrame:
    """Rows of shingles that members of several labels hold, with label and most frequent label."""
    labelled = store(rows.hint("merge").join(graph.labels, "node"), "labelled")
    by_label = labelled.groupBy("shingle", "label").agg(F.count("*").alias("k"))
    top = by_label.groupBy("shingle").agg(F.max_by("label", "k").alias("top"), F.count("*").alias("labels"))
    return store(labelled.hint("merge").join(store(top.where("labels > 1").select("shingle", "top"), "top"), "shingle"), "mixed")


def _one_each(mixed_rows: DataFrame) -> DataFrame:
    """Every member with one holder of each of its shingles, where they are not connected."""
    one = mixed_rows.groupBy("shingle").agg(F.max_by("node", F.xxhash64("node")).alias("p"), F.max_by("label", F.xxhash64("node")).alias("q"))
    return mixed_rows.hint("merge").join(store(one, "holders"), "shingle").where("label <> q").select(*_ordered())


def _rare_pairs(mixed_rows: DataFrame) -> DataFrame:
    """Unconnected pairs that share a rare shingle and can still reach the similarity.

    Rows of the most frequent label meet the other rows only. What two members share comes at or
    after their first common place, so a pair is dropped where too little is left behind it.
    """
    fewer = mixed_rows.where("label <> top").select("shingle", *[F.col(c).alias(d) for c, d in (("node", "p"), ("label", "q"), ("n", "m"), ("place", "other"))])
    left = 1 + F.least(F.col("n") - F.col("place"), F.col("m") - F.col("other"))
    once = (F.col("label") == F.col("top")) | (F.col("node") < F.col("p"))
    met = mixed_rows.hint("merge").join(fewer, "shingle")
    return met.where((F.col("label") != F.col("q")) & once & (left >= _needed(F.col("n"), F.col("m")))).select(*_ordered())


def _named(docs: DataFrame, several: DataFrame | None, ident: Column, text: Column) -> DataFrame:
    """Add ``_node``: the id, or for rows of ids with several texts a number of id and text."""
    docs = docs.withColumn("_node", ident.cast("long"))
    if several is None:
        return docs
    many = docs.join(several.withColumnRenamed("node", "_node").withColumn("_many", F.lit(True)), "_node", "left")
    return many.withColumn("_node", F.when(F.col("_many"), F.xxhash64("_node", text)).otherwise(F.col("_node"))).drop("_many")


def _found(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows (node, doc, n, component_id, kept), and the ids that have several texts."""
    own = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).where("node is not null")
    sketched = store(_sketches(own, False), "sketches")
    ends = [f(k).alias(f"{f.__name__}_{k}") for k in ("k1", "k2") for f in (F.min, F.max)]
    texts = sketched.groupBy("node").agg(*ends).where("min_k1 < max_k1 OR min_k2 < max_k2").select("node")
    if texts.isEmpty():
        rows = _linked(own, sketched)
        return rows.select("node", F.col("node").alias("doc"), "n", "component_id", (F.col("node") == F.col("component_id")).alias("kept")), None
    several = store(texts, "several")
    named = _named(own, several, F.col("node"), F.col("text"))
    renamed = named.select(F.col("_node").alias("node"), "text")
    names = store(named.where("_node <> node").select(F.col("_node").alias("node"), F.col("node").alias("doc")).distinct(), "names")
    rows = _linked(renamed, store(_sketches(renamed, False), "sketches"))
    rows = store(rows.join(names, "node", "left").withColumn("doc", F.coalesce("doc", "node")), "found")
    least = store(rows.groupBy("component_id").agg(F.min("doc").alias("least")), "least")
    rows = rows.hint("merge").join(least, "component_id").select("node", "doc", "n", F.col("least").alias("component_id"))
    return rows.withColumn("kept", F.col("doc") == F.col("component_id")), several


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_shingles, component_id and kept of every document.

    Documents are linked when their sets of five-word shingles (A-Z lower-cased) have a Jaccard
    similarity of at least 0.75; a component's id is its smallest document id, and that document is
    kept. A null text, or one without words, has no shingles and is linked with nothing; fewer than
    five words are one shingle. Rows without id are left out. Rows are documents of their own: rows
    that share an id but not the text are linked by their texts only and can have two components.
    """
    found, _ = _found(docs, id_col, text_col)
    return found.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def _linked(own: DataFrame, sketched: DataFrame) -> DataFrame:
    """Rows (node, n, component_id) of all rows (node, text); a node has one text."""
    filled = sketched.where("n > 0")
    classes = store(filled.groupBy("k1", "k2").agg(F.min("node").alias("rep")), "classes")
    members = store(filled.hint("merge").join(classes, ["k1", "k2"]).withColumn("sketch", F.expr("CASE WHEN node = rep THEN sketch END")), "members")
    bands = members.where("sketch is not null").select("rep", "n", "sketch").mapInArrow(_band_keys, "key long, node long, n long")
    sizes = bands.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.count("*").alias("size"))
    sizes = store(sizes.where("x < y").select("key", "size"), "sizes")
    shared = store(bands.hint("merge").join(sizes, "key"), "shared")
    # The sum of its buckets' sizes tells how central a document is among near copies.
    central = store(shared.groupBy("node").agg(F.sum("size").alias("mates")), "central")
    nodes = store(_sketches(own.join(central, "node", "left_semi"), True).select("node", "n", "sketch", "shingles"), "nodes")
    graph = _Graph(nodes)
    ranked = shared.hint("merge").join(central, "node")
    pivots = store(ranked.groupBy("key").agg(F.max_by("node", "mates").alias("p")), "pivots")
    graph.test(shared.hint("merge").join(pivots, "key").where("node <> p").select(*_ordered()))
    opened = graph.open(shared)
    if not opened.isEmpty():
        opened = graph.open(graph.prune(opened))
    if not opened.isEmpty():
        rare = _rare_shingles(graph, opened)
        graph.test(_one_each(_mixed(graph, rare)))
        graph.test(_rare_pairs(_mixed(graph, rare)))
    labels = graph.labels.select(F.col("node").alias("rep"), "label")
    moved = members.select("node", "n", "rep").hint("merge").join(labels, "rep", "left")
    found = moved.select("node", "n", F.coalesce("label", "rep").alias("component_id"))
    return found.unionByName(sketched.where("n = 0").select("node", "n", F.col("node").alias("component_id")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with all columns, one of each component: that with the smallest id.

    Documents without an id stay; of rows with the same kept id all stay. A row goes by its own text:
    another text of its id keeps its row.
    """
    found, several = _found(docs, id_col, text_col)
    gone = store(found.where("not kept").select(F.col("node").alias("_gone")).distinct(), "gone")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = docs.select(whole, F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = _named(rows, several, F.col("_id"), F.col("_text"))
    return rows.join(gone.hint("merge"), F.col("_node") == F.col("_gone"), "left_anti").select("_doc.*")
