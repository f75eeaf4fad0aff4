"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, texts without regard to any label are the unlabelled set. A
linear model over hashed words and word beginnings minimises the risk estimate that is corrected by
the class prior and held at zero from below: where the estimated risk on negatives goes negative, the
step is taken against it. It sees the features whose counts in positives are surely not those of the
unlabelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.llm import features as X
from querymill.llm.words import NOT_ALNUM, Words, slices

#: Bounds of the training sample.
MAX_POSITIVE, MAX_UNLABELLED = 4_000, 8_000
#: A prior read from the labels stays so far from 0 and 1, where it has no log-odds.
PRIOR_MARGIN = 0.001
PREFIXES = (5, 6, 7)
#: Standard deviations by which a feature's count in positives must be off.
MIN_DEVIATION = 3.0
STEPS, RATE = 300, 0.02


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0


def _pairs(column: pa.Array, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    words = Words(column, NOT_ALNUM)
    rows = np.repeat(np.arange(len(words)), words.counts)
    made = X.word_features(words, PREFIXES)
    if keep is None:
        return X.distinct([rows] * len(made), made)
    used = [keep[f] for f in made]
    return X.distinct([rows[k] for k in used], [f[k] for f, k in zip(made, used)])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (id, positive, text): id, positive, features."""
    for batch in batches:
        for part in slices(batch, 2):
            rows, found = _pairs(part.column(2))
            yield pa.RecordBatch.from_arrays([*part.columns[:2], X.packed(rows, found, part.num_rows)], names=["id", "positive", "features"])


def nnpu_slope(positive: np.ndarray, prior: float, z: np.ndarray) -> np.ndarray:
    """Derivative of the non-negative risk by each score, for the logistic loss."""
    p, u = positive, ~positive
    s, n_p, n_u = X.sigmoid(z), max(1, p.sum()), max(1, u.sum())
    loss = np.logaddexp(0, z)
    out = np.zeros(len(z))
    if loss[u].sum() / n_u >= prior * loss[p].sum() / n_p:
        # Positives as positives, less positives as negatives: the two slopes add up to the prior.
        out[p], out[u] = -prior / n_p, s[u] / n_u
    else:
        out[p], out[u] = prior * s[p] / n_p, -s[u] / n_u
    return out


def deviating(features: list[np.ndarray], positive: np.ndarray) -> np.ndarray:
    """Features whose count in positives is far from what the unlabelled rows let expect."""
    count = lambda rows: np.bincount(np.concatenate([features[i] for i in rows] or [np.zeros(0, int)]), minlength=X.DIMS)
    p, u = np.flatnonzero(positive), np.flatnonzero(~positive)
    expected = count(u) * len(p) / max(1, len(u))
    return np.abs(count(p) - expected) >= MIN_DEVIATION * np.sqrt(expected + 1)


class Model:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self, column: pa.Array) -> np.ndarray:
        rows, found = _pairs(column, self.weights != 0)
        return X.sigmoid(X.scores(rows, found, self.weights, len(column)) + self.intercept)


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED,
    steps: int = STEPS,
    prior: float | None = None,
) -> Model:
    """A model from at most ``max_positive`` toxic texts and ``max_unlabelled`` others.

    Only labels of rows that are not held out are read. ``prior`` is the share of toxic texts among
    the unlabelled; left out, it is the share among the labels, kept within 0.001 and 0.999. Without
    positives every score is that of the prior alone.

    The unlabelled texts estimate the risk on negatives: its standard error is in proportion to
    1 / sqrt(max_unlabelled) whatever the size of the corpus. Raise the bounds with memory of the
    driver in mind (about 2 kB a text). An id with several texts counts as one row, that with the
    smallest features as bytes; rows without an id are scored but not learned from.
    """
    if prior is not None and not 0 < prior < 1:
        raise ValueError("The prior lies between 0 and 1")
    known = labels.where(~held_out(id_col) & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_toxic"))
    if prior is None:
        share = known.agg(F.avg((F.col("_toxic") == 1).cast("double"))).first()[0]
        prior = min(max(share or 0.0, PRIOR_MARGIN), 1 - PRIOR_MARGIN)
    positive = X.bounded(known.where("_toxic = 1"), max_positive, "_id")
    unlabelled = X.bounded(docs.where(~held_out(id_col)).select(F.col(id_col).alias("_id")), max_unlabelled, "_id")
    # Both sides are bounded by their limits.
    chosen = positive.withColumn("positive", F.lit(True)).unionByName(unlabelled.withColumn("positive", F.lit(False)))
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    made = own.join(F.broadcast(chosen), "_id").select("_id", "positive", "_text").mapInArrow(_featured, f"id {kind}, positive boolean, features binary")
    rows = made.groupBy("id", "positive").agg(F.min("features").alias("features")).collect()
    rows.sort(key=lambda r: (r["id"], r["positive"]))
    is_positive = np.array([r["positive"] for r in rows], bool)
    if not is_positive.any():
        return Model(np.zeros(X.DIMS, np.float32), float(np.log(prior / (1 - prior))))
    found = X.unpack([r["features"] for r in rows])
    sample = X.Sample(found, deviating(found, is_positive))
    weights, intercept = sample.fit(np.arange(sample.n), lambda z: nnpu_slope(is_positive, prior, z), steps, RATE)
    return Model(weights, intercept)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the score of every text; a null or empty text gets the intercept's."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 4 MB of weights whatever the data

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = shared.value.score(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(work, f"`{id_col}` {kind}, score double")


def digest(scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
