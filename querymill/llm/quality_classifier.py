"""Quality by co-training a text-content view and a page-metadata view.

The content view sees words and word endings; the metadata view sees language, source, length and
layout (lines, line lengths, shares of symbols, capitals, digits, repeated words). In every round
each view labels those texts of an unlabelled pool that it is surest about, for the other view to
learn from. Both are calibrated on labelled rows they did not learn from and combined there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.llm import features as X
from querymill.llm.words import Words, slices, span_hashes

#: Bounds of the training sample.
MAX_LABELLED, MAX_POOL = 5_000, 5_000
ROUNDS = 3
#: Pseudo-labels that a view hands over in a round, and how sure it must be of them.
PER_ROUND, SURE = 500, 0.95
STEPS = 80
ADDED = ("quality_score", "content_score", "metadata_score", "quality_kept")
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>!{}[]=~^_\\")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from, for measuring."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0


def _names(column: pa.Array) -> np.ndarray:
    """A hash of each whole name; null is one of its own."""
    filled = pc.fill_null(column.cast(pa.large_string()), "\0null")
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    raw = filled.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[: offsets[-1]] if raw else np.zeros(0, np.uint8)
    return span_hashes(data, offsets[:-1], offsets[1:]).view(np.int64)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.ceil(np.minimum(20, 20 * part / np.maximum(1, whole))).astype(int)


def _views(texts: pa.Array, lang: pa.Array, source: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(row, feature) pairs of the content view and of the metadata view."""
    words = Words(texts)
    n = len(words)
    rows = np.repeat(np.arange(n), words.counts)
    made = X.word_features(words, suffixes=(2, 3))
    content = X.distinct([rows] * len(made), made)
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[words.offsets])
    size = np.diff(words.offsets)
    lines = sums(words.data == 0x0A) + 1
    distinct_words = np.bincount(np.unique(rows << 44 | (made[0] << np.uint64(0)).astype(np.int64)) >> 44, minlength=n)
    values = [
        np.log2(size + 1).astype(int),
        np.log2(lines).astype(int),
        np.log2(words.counts / lines + 1).astype(int),
        _share(sums(_SYMBOLS[words.data]), size),
        _share(sums(_UPPER[words.data]), size),
        _share(sums(_DIGIT[words.data]), size),
        _share(words.counts - distinct_words, words.counts) * 16 + np.log2(words.counts + 1).astype(int),
        _names(lang),
        _names(source),
    ]
    buckets = [X.bucket_feature(i, v) for i, v in enumerate(values)]
    return content, X.distinct([np.arange(n)] * len(buckets), buckets)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (id, label, text, lang, source): label, content, meta."""
    for batch in batches:
        for part in slices(batch, 2):
            content, meta = _views(*part.columns[2:])
            columns = [part.column(0), part.column(1), *(X.packed(*v, part.num_rows) for v in (content, meta))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "content", "meta"])


class Model:
    """Weights and intercept of both views, and the calibrated combination of their scores."""

    def __init__(self, views: list[tuple[np.ndarray, float]], mix: np.ndarray, single: np.ndarray):
        self.views, self.mix, self.single = views, mix, single

    def score(self, texts: pa.Array, lang: pa.Array, source: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.stack([X.scores(*v, w, len(texts)) + b for v, (w, b) in zip(_views(texts, lang, source), self.views)], 1)
        alone = X.sigmoid(z * self.single[:, 0] + self.single[:, 1])
        return X.sigmoid(np.tanh(z / 8) * 8 @ self.mix[:2] + self.mix[2]), alone[:, 0], alone[:, 1]


def _logistic(z: np.ndarray, y: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights and intercept (last) of a small logistic regression, not negative on the scores."""
    a = np.column_stack([z, np.ones(len(y))])
    w = np.append(np.full(z.shape[1], 1.0 / z.shape[1]), 0.0)
    for _ in range(steps):
        w -= 0.3 * (a.T @ (X.sigmoid(a @ w) - y) / len(y) + 1e-3 * w) / (1 + np.abs(a).mean(0))
        w[:-1] = np.maximum(w[:-1], 0.01)
    return w


def co_train(content: list[np.ndarray], meta: list[np.ndarray], labels: np.ndarray, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> Model:
    """Labels are 0, 1, or -1 for the pool. A quarter of the labelled rows is kept for calibration."""
    known = np.flatnonzero(labels >= 0)
    if len(known) < 8 or len(np.unique(labels[known])) < 2:
        rate = labels[known].mean() if len(known) else 1.0
        level = float(np.log((rate + 0.01) / (1.01 - rate)))
        return Model([(np.zeros(X.DIMS, np.float32), 0.0)] * 2, np.array([0, 0, level]), np.array([[0, level]] * 2))
    check = known[::4]
    own = np.setdiff1d(known, check)
    if len(np.unique(labels[check])) < 2 or len(np.unique(labels[own])) < 2:
        check = own = known
    samples = [X.Sample(content), X.Sample(meta)]
    given = [dict(zip(own.tolist(), labels[own].astype(float).tolist())) for _ in samples]
    pool = np.flatnonzero(labels < 0)
    fitted: list[tuple[np.ndarray, float]] = []
    for round_ in range(rounds + 1):
        fitted = []
        for sample, known_to in zip(samples, given):
            rows, y = np.array(list(known_to)), np.array(list(known_to.values()))
            fitted.append(sample.fit(rows, lambda z, y=y: (X.sigmoid(z) - y) / len(y), STEPS))
        if round_ == rounds or not len(pool):
            break
        for i, (sample, model) in enumerate(zip(samples, fitted)):
            p = X.sigmoid(sample.apply(*model, pool))
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                share = (labels[own] == label).mean()
                best = np.argsort(-sure, kind="stable")[: max(1, round(per_round * share))]
                for row in pool[best[sure[best] >= SURE]].tolist():
                    given[1 - i].setdefault(row, label)
    z = np.stack([s.apply(*m, check) for s, m in zip(samples, fitted)], 1)
    y = labels[check].astype(float)
    return Model(fitted, _logistic(np.tanh(z / 8) * 8, y), np.array([_logistic(z[:, [i]], y) for i in range(2)]))


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    label_col: str = "quality",
    max_labelled: int = MAX_LABELLED,
    max_pool: int = MAX_POOL,
) -> Model:
    """A model from at most ``max_labelled`` labelled texts and a pool of at most ``max_pool``.

    A round takes at most ``PER_ROUND`` texts of the pool, so a larger pool gives surer pseudo-labels,
    not more of them. An id with several rows counts as one, that with the smallest features as bytes;
    of several labels of one id the largest counts. Rows without an id are scored but not learned from.
    """
    known = labels.where(~held_out(id_col) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    chosen = known.join(F.broadcast(X.bounded(known, max_labelled, "_id")), "_id")
    pool = X.bounded(docs.select(F.col(id_col).alias("_id")), max_pool, "_id", 1)
    # Both sides are bounded by their limits; a labelled row is not in the pool.
    picked = chosen.unionByName(pool.withColumn("_label", F.lit(-1))).groupBy("_id").agg(F.max("_label").alias("_label"))
    own = docs.select(F.col(id_col).alias("_id"), "text", "lang", "source")
    rows = own.join(F.broadcast(picked), "_id").select("_id", "_label", "text", "lang", "source")
    kind = docs.schema[id_col].dataType.simpleString()
    made = rows.mapInArrow(_featured, f"id {kind}, label int, content binary, meta binary")
    found = made.groupBy("id", "label").agg(F.min(F.struct("content", "meta")).alias("views")).select("id", "label", "views.*").collect()
    found.sort(key=lambda r: r["id"])
    return co_train(X.unpack([r["content"] for r in found]), X.unpack([r["meta"] for r in found]), np.array([r["label"] for r in found], int))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Documents with all columns, quality_score, content_score, metadata_score and quality_kept.

    Null texts, languages and sources are values of their own; no row goes. Input columns named like
    an added one, whatever their case, are replaced.
    """
    docs = docs.drop(*ADDED)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB of weights whatever the data
    at = [docs.columns.index(c) for c in ("text", "lang", "source")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at[0]):
                made = shared.value.score(*[part.column(i) for i in at])
                columns = [*part.columns, *(pa.array(x, pa.float64()) for x in made), pa.array(made[0] >= threshold)]
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    kinds = [f.dataType.simpleString() for f in docs.schema.fields] + ["double"] * 3 + ["boolean"]
    out = docs.mapInArrow(work, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
    return out.toDF(*docs.columns, *ADDED)
