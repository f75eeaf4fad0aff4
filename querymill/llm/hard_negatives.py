"""Hard negatives by angular triangle filtering.

Every row keeps its angles to a few reference directions. For an anchor and a tile of rows that are
close in angle, the triangle inequality on the sphere gives an interval of angles between them; its
cosines times the norms bound the scores, rounded outwards. Only tiles whose interval overlaps the
scores that are still wanted are scored, exactly, in integers. Any references keep the result exact;
good ones only skip more.

Anchors are the query set: blocks of them, of fixed size, are sent to all tasks. Each task keeps its
best rows per anchor across its tiles, and these are ranked again over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.llm.words import mixed
from querymill.storage import store

#: Reference directions, and rows of the sample that they are fitted on (any bound keeps results exact).
REFERENCES, SAMPLE = 16, 2048
#: Rows that are bounded and scored together, and anchors sent to the tasks at once.
TILE, ANCHORS = 512, 4096
#: Scores are exact up to here.
EXACT = float(1 << 53)
_ANGLE_SLACK, _SCORE_SLACK = 1e-6, 1e-9
_NONE = np.iinfo(np.int64).min
_NO_ID = np.iinfo(np.int64).max
_ROW = "vec_id long, label long, anchor boolean, size int, vector binary"


def quantised(embeddings: DataFrame, anchors: Column, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows that take part, their components scaled and floored, as packed 64-bit integers."""
    ids, labels = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    vector = F.col(vector_col).cast("array<double>")
    rows = embeddings.select(ids.alias("vec_id"), labels.alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), vector.alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat = lists.flatten()
            offsets = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64))])
            values = np.asarray(pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False), np.float64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])[offsets]
            scaled = np.floor(scale * np.where(np.isfinite(values), values, 0))
            squares = np.concatenate([[0.0], np.cumsum(np.minimum(np.abs(scaled), 2**30) ** 2)])
            good = (np.diff(bad) == 0) & np.asarray(lists.is_valid())
            if (np.diff(squares[offsets])[good] >= EXACT).any() or (np.abs(scaled) >= 2**30).any():
                raise ValueError("Scores of such long vectors pass 2^53; use a smaller scale")
            ints = scaled.astype(np.int64)
            picked = np.flatnonzero(good).tolist()
            packed = pa.array([ints[offsets[i] : offsets[i + 1]].tobytes() for i in picked], pa.binary())
            sizes = pa.array(np.diff(offsets)[picked].astype(np.int32), pa.int32())
            take = pa.array(picked, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(3)], sizes, packed], names=["vec_id", "label", "anchor", "size", "vector"])

    return rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").mapInArrow(pack, _ROW)


def unpacked(column: pa.Array | list[bytes], width: int) -> np.ndarray:
    """Packed vectors as rows of floats (whole numbers), shorter ones filled with zeros."""
    out = np.zeros((len(column), width))
    for i, x in enumerate(column.to_pylist() if isinstance(column, pa.Array) else column):
        v = np.frombuffer(x, np.int64)
        out[i, : len(v)] = v
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def references(sample: np.ndarray, count: int = REFERENCES, rounds: int = 6) -> np.ndarray:
    """Unit directions by spherical k-means, started farthest first."""
    units = _unit(sample[np.linalg.norm(sample, axis=1) > 0])
    if not len(units):
        return np.eye(1, sample.shape[1])
    chosen = [_unit(units.sum(0, keepdims=True))[0] if np.linalg.norm(units.sum(0)) else units[0]]
    while len(chosen) < min(count, len(units)):
        chosen.append(units[np.argmin((units @ np.array(chosen).T).max(1))])
    out = np.array(chosen)
    for _ in range(rounds):
        near = (units @ out.T).argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, near, units)
        full = np.linalg.norm(sums, axis=1) > 1e-9
        out[full] = _unit(sums[full])
    return out


def angles(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles of rows to directions; a zero vector counts as at angle 0 (its scores are 0 anyway)."""
    return np.arccos(np.clip(np.where(x.any(1)[:, None], _unit(x) @ directions.T, 1.0), -1, 1))


def score_bounds(a_norm: np.ndarray, a_angles: np.ndarray, norms: np.ndarray, row_angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of each anchor with any row of a tile, rounded outwards."""
    low, high = row_angles.min(0), row_angles.max(0)
    near = np.maximum(np.maximum(a_angles - high, low - a_angles).max(1), 0) - _ANGLE_SLACK
    far = np.minimum(np.minimum(a_angles + high, 2 * np.pi - a_angles - low).min(1), np.pi) + _ANGLE_SLACK
    top, bottom = np.cos(np.maximum(near, 0)), np.cos(np.minimum(far, np.pi))
    least, most = norms.min(), norms.max()
    slack = _SCORE_SLACK * a_norm * most + 1
    upper = a_norm * np.where(top >= 0, most, least) * top + slack
    lower = a_norm * np.where(bottom >= 0, least, most) * bottom - slack
    return lower, upper


class Best:
    """The k best (score, id) of each group, equal scores by smaller id."""

    def __init__(self, groups: int, k: int):
        self.scores = np.full((groups, k), _NONE)
        self.ids = np.full((groups, k), _NO_ID)

    def add(self, group: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        touched = np.unique(group)
        if not len(touched):
            return
        k = self.scores.shape[1]
        g = np.concatenate([np.repeat(touched, k), group])
        s = np.concatenate([self.scores[touched].ravel(), score])
        i = np.concatenate([self.ids[touched].ravel(), ident])
        order = np.lexsort((i, -s, s == _NONE, g))
        g, s, i = g[order], s[order], i[order]
        place = np.arange(len(g)) - np.searchsorted(g, g)
        keep = place < k
        self.scores[g[keep], place[keep]] = s[keep]
        self.ids[g[keep], place[keep]] = i[keep]

    @property
    def floor(self) -> np.ndarray:
        """The score that a row must reach."""
        return self.scores[:, -1]

    def batch(self) -> pa.RecordBatch:
        g, place = np.nonzero(self.scores != _NONE)
        return pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(self.scores[g, place]), pa.array(self.ids[g, place])], names=["g", "score", "vec_id"])


class Anchors:
    """A block of anchors as arrays."""

    def __init__(self, rows: list, width: int, directions: np.ndarray):
        self.ids = np.array([r["vec_id"] for r in rows], np.int64)
        self.labels = np.array([r["label"] for r in rows], np.int64)
        self.vectors = unpacked([bytes(r["vector"]) for r in rows], width)
        self.norms = np.linalg.norm(self.vectors, axis=1)
        self.angles = angles(self.vectors, directions)


def _tiles(batches: Iterator[pa.RecordBatch], width: int, directions: np.ndarray) -> Iterator[tuple]:
    """Tiles of rows: ids, labels, vectors, norms, angles."""
    for batch in batches:
        for start in range(0, batch.num_rows, TILE):
            part = batch.slice(start, TILE)
            x = unpacked(part.column(2), width)
            yield np.asarray(part.column(0)), np.asarray(part.column(1)), x, np.linalg.norm(x, axis=1), angles(x, directions)


def _wanted(block: Anchors, tile: tuple, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors whose wanted scores overlap the tile's interval, and their exact scores."""
    _, _, x, norms, row_angles = tile
    lower, upper = score_bounds(block.norms, block.angles, norms, row_angles)
    active = np.flatnonzero((upper >= low) & (lower <= high))
    return active, block.vectors[active] @ x.T


def _positives(block: Anchors, k: int, width: int, directions: np.ndarray) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, no_cap = Best(len(block.ids), k), np.full(len(block.ids), np.inf)
        for tile in _tiles(batches, width, directions):
            floor = np.where(best.floor == _NONE, -np.inf, best.floor)
            active, scores = _wanted(block, tile, floor, no_cap)
            same = (block.labels[active][:, None] == tile[1]) & (block.ids[active][:, None] != tile[0])
            a, x = np.nonzero(same & (scores >= floor[active][:, None]))
            best.add(active[a], scores[a, x].astype(np.int64), tile[0][x])
        yield best.batch()

    return search


def _negatives(block: Anchors, low: np.ndarray, high: np.ndarray, k: int, width: int, directions: np.ndarray) -> Callable:
    """``low`` and ``high``: the window of each anchor and positive; an empty window wants nothing."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = low.shape[1]
        best = Best(low.size, k)
        for tile in _tiles(batches, width, directions):
            floor = np.maximum(low, best.floor.reshape(low.shape).astype(np.float64))
            widest = np.where(floor <= high, floor, np.inf).min(1)
            active, scores = _wanted(block, tile, widest, high.max(1))
            a, x = np.nonzero((scores >= widest[active][:, None]) & (scores <= high[active].max(1)[:, None]) & (block.labels[active][:, None] != tile[1]))
            own, found = active[a], scores[a, x]
            pair, slot = np.nonzero((found[:, None] >= floor[own]) & (found[:, None] <= high[own]))
            best.add(own[pair] * slots + slot, found[pair].astype(np.int64), tile[0][x[pair]])
        yield best.batch()

    return search


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("g").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    embeddings: DataFrame,
    anchors: Column,
    *,
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """For each anchor and positive, the best rows of other labels inside a share of its score.

    A score is the inner product of components scaled and floored, an exact integer. An anchor's
    positives are its ``positives`` best other rows of its label, its negatives the ``negatives`` best
    rows of other labels with ``low_percent * p <= 100 * score <= high_percent * p``; equal scores go by
    smaller id. Rows without id or label, and vectors that are null or hold a null or non-finite
    component, take no part. Rows that share an id count each, but a row is no positive of an anchor of
    its own id. Shorter vectors are filled with zeros; a negative score of a positive leaves no window.
    Scores beyond 2^53 raise. Other columns are ignored; an empty table or no anchors give no rows.
    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = embeddings.sparkSession
    packed = store(quantised(embeddings, anchors, scale, id_col, vector_col, label_col), "quantised")
    total, width = packed.agg(F.count("*"), F.max("size")).first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not total:
        return empty
    part = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(max(1, total // SAMPLE))) == 0
    sample = packed.where(part).select("vector").limit(2 * SAMPLE).collect()
    width = max(width, 1)
    directions = references(unpacked([bytes(r[0]) for r in sample] or [b""], width))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_angles = angles(unpacked(batch.column(4), width), directions)
            near = all_angles.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(all_angles[np.arange(len(near)), near])], names=[*batch.schema.names, "cell", "angle"])

    placed = packed.mapInArrow(place, f"{_ROW}, cell int, angle double")
    rows = store(placed.repartitionByRange("cell", "angle", "vec_id").sortWithinPartitions("cell", "angle", "vec_id"), "by-angle")
    queries = store(rows.where("anchor").select("vec_id", "label", "vector"), "anchors")
    scanned = rows.select("vec_id", "label", "vector")

    out, each = [], queries.toLocalIterator()
    while block_rows := list(islice(each, ANCHORS)):
        block = Anchors(block_rows, width, directions)
        best = scanned.mapInArrow(_positives(block, positives, width, directions), "g long, score long, vec_id long")
        score, ident = np.zeros((len(block.ids), positives), np.int64), np.zeros((len(block.ids), positives), np.int64)
        there = np.zeros(score.shape, bool)
        for r in _ranked(best, positives).collect():  # a few rows for each anchor of the block
            at = (r["g"], r["rank"] - 1)
            score[at], ident[at], there[at] = r["score"], r["vec_id"], True
        low = np.where(there, -(-low_percent * score // 100), 1).astype(np.float64)
        high = np.where(there, high_percent * score // 100, 0).astype(np.float64)
        found = scanned.mapInArrow(_negatives(block, low, high, negatives, width, directions), "g long, score long, vec_id long")
        pairs = spark.createDataFrame(
            pa.table({"g": np.arange(score.size), "anchor_id": np.repeat(block.ids, positives), "positive_id": ident.ravel(), "positive_score": score.ravel()})
        )
        named = _ranked(found, negatives).join(F.broadcast(pairs), "g")  # as many rows as the block has pairs
        out.append(store(named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "mined"))
    if not out:
        return empty
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole
