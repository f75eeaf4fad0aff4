"""Hashed sparse features of texts, and linear models over them in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.llm.words import _LOWER, _MASKS, Words, mixed

BITS = 20
DIMS = 1 << BITS
#: A feature must be in so many rows of a training sample.
MIN_ROWS = 4


def _eights(words: Words) -> np.ndarray:
    padded = np.concatenate([_LOWER[words.data], np.zeros(8, np.uint8)])
    return np.ndarray(len(words.data) + 1, "<u8", padded.data, strides=(1,))


def word_features(words: Words, prefixes: tuple[int, ...] = (), suffixes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """Feature numbers of every word: the word, and its first or last bytes where it is longer."""
    sizes, eights = words.ends - words.starts, _eights(words)
    out = [words.hashes() & np.uint64(DIMS - 1)]
    for n in prefixes:
        key = (eights[words.starts] & _MASKS[n]) + np.uint64(n << 58)
        out.append(np.where(sizes > n, mixed(key) & np.uint64(DIMS - 1), out[0]))
    for n in suffixes:
        key = (eights[np.maximum(words.ends - n, 0)] & _MASKS[n]) + np.uint64((n + 8) << 58)
        out.append(np.where(sizes > n, mixed(key) & np.uint64(DIMS - 1), out[0]))
    return out


def bucket_feature(name: int, bucket: np.ndarray) -> np.ndarray:
    """Feature number of a named value bucket."""
    return mixed(bucket.astype(np.int64).astype(np.uint64) + np.uint64((name + 1) << 40)) & np.uint64(DIMS - 1)


def distinct(rows: list[np.ndarray], features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs, by row."""
    code = np.unique(np.concatenate([r.astype(np.int64) << BITS | f.astype(np.int64) for r, f in zip(rows, features)]))
    return code >> BITS, code & (DIMS - 1)


def scores(rows: np.ndarray, features: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Sum of weights of each row's features."""
    return np.bincount(rows, weights[features], minlength=n)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Sample:
    """Rows of a bounded training sample as sparse features that occur in enough rows."""

    def __init__(self, features: list[np.ndarray], keep: np.ndarray | None = None):
        if keep is not None:
            features = [f[keep[f]] for f in features]
        seen = np.bincount(np.concatenate([*features, np.zeros(0, np.int64)]).astype(np.int64), minlength=DIMS)
        self.known = np.flatnonzero(seen >= MIN_ROWS)
        at = np.full(DIMS, -1, np.int32)
        at[self.known] = np.arange(len(self.known))
        kept = [at[f] for f in features]
        kept = [k[k >= 0] for k in kept]
        self.n = len(kept)
        self.starts = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int64)
        self.columns = np.concatenate([*kept, np.zeros(0, np.int32)]).astype(np.int32)

    def pick(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row number within ``rows``, column) of their features."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        total = np.cumsum(sizes)
        at = np.arange(total[-1] if len(total) else 0) + np.repeat(self.starts[rows] - (total - sizes), sizes)
        return np.repeat(np.arange(len(rows)), sizes), self.columns[at]

    def fit(self, rows: np.ndarray, slope: Callable[[np.ndarray], np.ndarray], steps: int, rate: float = 0.05, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
        """Weights over all features and the intercept, by Adam steps over the rows.

        ``slope`` gives the derivative of the loss by each row's score.
        """
        r, c = self.pick(rows)
        w, moment, square = (np.zeros(len(self.known) + 1) for _ in range(3))
        for step in range(1, steps + 1):
            z = np.bincount(r, w[c], minlength=len(rows)) + w[-1]
            d = slope(z)
            g = np.append(np.bincount(c, d[r], minlength=len(self.known)) + penalty * w[:-1], d.sum())
            moment, square = 0.9 * moment + 0.1 * g, 0.99 * square + 0.01 * g * g
            w -= rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        weights = np.zeros(DIMS, np.float32)
        weights[self.known] = w[:-1]
        return weights, float(w[-1])

    def apply(self, weights: np.ndarray, intercept: float, rows: np.ndarray) -> np.ndarray:
        """Scores of rows of the sample."""
        r, c = self.pick(rows)
        return np.bincount(r, weights[self.known][c], minlength=len(rows)) + intercept


#: Rows of one hash prefix that are looked through without a longer prefix.
FEW = 1 << 20


def bounded(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """At most ``n`` different keys, those with the smallest hashes: the same ones on every run.

    Rows are counted by hash prefix (4,096 groups, where one is large 4,096 more), and only keys up to
    the prefix at which the count reaches ``n`` are brought together. If repeated keys leave fewer than
    ``n`` different ones there, the range is doubled. Null keys are left out.
    """
    hash_, last = F.col("_hash"), (1 << 63) - 1
    hashed = rows.where(F.col(key).isNotNull()).select(key, F.xxhash64(F.lit(seed), key).alias("_hash"))
    bound, before, part = last, 0, hashed
    for shift in (52, 40):
        counts = part.groupBy(F.shiftright(hash_, shift).alias("slot")).agg(F.count("*").alias("n")).collect()
        for slot, found in sorted((r["slot"], r["n"]) for r in counts):
            if before + found >= n:
                bound = ((slot + 1) << shift) - 1
                break
            before += found
        else:
            break
        if found <= FEW:
            break
        part = part.where(F.shiftright(hash_, shift) == slot)
    while bound < last and hashed.where(hash_ <= bound).distinct().count() < n:
        bound = min(last, 2 * bound + (1 << 63) + 1)
    return hashed.where(hash_ <= bound).distinct().orderBy(hash_, key).limit(n).select(key)


def unpack(column: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32).astype(np.int64) for x in column]


def packed(rows: np.ndarray, features: np.ndarray, n: int) -> pa.Array:
    """Features of each row as bytes, for collecting a sample."""
    edges = np.searchsorted(rows, np.arange(n + 1))
    flat = features.astype(np.int32)
    return pa.array([flat[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())
