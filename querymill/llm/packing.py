"""Best-fit packing of all documents into sequences, after a dominance reduction.

Lengths are at most the capacity, so the whole instance is a histogram with as many rows as the
capacity, whatever the number of documents. The plan is made for classes of equal lengths: sets of
one to three that provably dominate every other choice (Martello and Toth) are fixed first, the
rest goes to the fullest sequence that still holds it. Documents then find their place by their
number within their length, which tasks count for themselves while encoding.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.llm import ids as token_ids
from querymill.llm.words import slices
from querymill.storage import store

PIECES = "doc_id long, piece int, start long, length long, ids binary, bucket int, rank long"
#: Bits of a rank in the key (length, rank) of the plan.
_RANK_BITS = 49


@dataclass
class Plan:
    """Where the items of each length go: segments of (length, first rank, sequence, per sequence, offset)."""

    capacity: int
    sequences: int = 0
    fixed: int = 0  # sequences that the reduction closed
    segments: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    _placed: dict[int, int] = field(default_factory=lambda: defaultdict(int))

    def put(self, length: int, items: int, sequence: int, per_sequence: int, offset: int) -> None:
        self.segments.append((length, self._placed[length], sequence, per_sequence, offset))
        self._placed[length] += items

    def new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n


def _largest(counts: list[int], most: int, item: int) -> int:
    """The largest length up to ``most`` that is there besides one ``item``; 0 without one."""
    for x in range(most, 0, -1):
        if counts[x] > (x == item):
            return x
    return 0


def _smallest(counts: list[int], item: int, n: int, above: int = 0) -> list[int]:
    """The ``n`` shortest lengths over ``above``, with repetition, besides one ``item``."""
    out: list[int] = []
    for x in range(above + 1, len(counts)):
        out += [x] * min(counts[x] - (x == item), n - len(out))
        if len(out) >= n:
            break
    return out


def _dominating(counts: list[int], capacity: int, item: int) -> tuple[int, ...] | None:
    """Lengths that may join ``item`` in a set that dominates all feasible sets with it."""
    room = capacity - item
    best = _largest(counts, room, item)
    if not best:
        return ()
    low = _smallest(counts, item, 3)
    if best == room or len(low) < 2 or low[0] + low[1] > room:
        return (best,)
    if len(low) == 3 and sum(low) <= room:
        return None
    # Two others fit, three don't: the pair with the largest sum.
    counts[item] -= 1
    first, second = 0, 0
    b = 1
    for a in range(room - 1, 0, -1):
        if counts[a]:
            b = min(a, room - a)
            while b and not (counts[b] > (a == b)):
                b -= 1
            if b and a + b > first + second:
                first, second = a, b
    counts[item] += 1
    if best >= first + second:
        return (best,)
    if best == first:
        both = _smallest(counts, item, 2, above=second)
        if len(both) < 2 or sum(both) > room:
            return (first, second)
    return None


def reduce(counts: list[int], plan: Plan) -> None:
    """Fix dominating sets until none is found; ``counts`` keeps what is left."""
    changed = True
    while changed:
        changed = False
        for item in range(plan.capacity, 0, -1):
            while counts[item]:
                with_it = _dominating(counts, plan.capacity, item)
                if with_it is None:
                    break
                members = (item, *with_it)
                times = min(counts[x] // members.count(x) for x in set(members))
                first, offset = plan.new(times), 0
                for x in dict.fromkeys(members):
                    k = members.count(x)
                    plan.put(x, k * times, first, k, offset)
                    counts[x] -= k * times
                    offset += k * x
                plan.fixed += times
                changed = True


def best_fit(counts: list[int], plan: Plan) -> None:
    """Best fit of the rest, longest first; equal sequences are filled together."""
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs of (first sequence, number)
    for length in range(plan.capacity, 0, -1):
        left, room = counts[length], length
        while left:
            while room <= plan.capacity and not open_.get(room):
                room += 1
            if room > plan.capacity:
                fits = plan.capacity // length
                n = max(1, left // fits)
                open_[plan.capacity].append((plan.new(n), n))
                room = plan.capacity
            first, n = open_[room].pop()
            fits = room // length
            full = min(n, left // fits)
            used, each = (full, fits) if full else (1, left)
            plan.put(length, used * each, first, each, plan.capacity - room)
            left -= used * each
            if n > used:
                open_[room].append((first + used, n - used))
            if rest := room - each * length:
                open_[rest].append((first, used))
            room = length
        counts[length] = 0


def make_plan(histogram: dict[int, int], capacity: int) -> Plan:
    """The plan for a number of items of each length."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    plan = Plan(capacity)
    reduce(counts, plan)
    best_fit(counts, plan)
    return plan


def pieces(
    docs: DataFrame,
    *,
    vocabulary: str | None = None,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encoded documents, cut into pieces of at most ``capacity`` ids; stored.

    A null text is the end id alone. Only longer documents are cut, from their end, so the first
    piece may be shorter. ``bucket`` and ``rank`` number the pieces of a length within their task.
    Other columns are ignored, repeated rows are packed as often as they occur.
    """
    path = vocabulary or token_ids.vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        encoder = token_ids.encoder(path)
        for batch in batches:
            for part in slices(batch, 1):
                flat, at = encoder.encode(part.column(1))
                rows: list[tuple] = []
                for i, doc in enumerate(part.column(0).to_pylist()):
                    own = np.append(flat[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                    stop = (len(own) - 1) % capacity + 1
                    start = number = 0
                    while start < len(own):
                        n = stop - start
                        rows.append((doc, number, start, n, own[start:stop].tobytes(), bucket, int(seen[n])))
                        seen[n] += 1
                        start, stop, number = stop, stop + capacity, number + 1
                names = ["doc_id", "piece", "start", "length", "ids", "bucket", "rank"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    read = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return store(read.mapInArrow(encode, PIECES), "pieces")


def place(cut: DataFrame, capacity: int = 2048, keep: dict[str, Column] | None = None) -> DataFrame:
    """Give each piece its sequence_id and offset; ``keep`` adds columns computed before the shuffle."""
    per_bucket = cut.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in per_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = make_plan(histogram, capacity)  # at most ``capacity`` rows came to the driver
    rows = np.array(sorted(plan.segments), np.int64).reshape(-1, 5)
    keys = rows[:, 0] << _RANK_BITS | rows[:, 1]
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_bucket.select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = cut.select("doc_id", "piece", "start", "length", "bucket", "rank", *[c.alias(n) for n, c in (keep or {}).items()])
    ranked = own.join(bases, ["bucket", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("bucket", "base")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(n)) for n in ("length", "rank"))
            segment = np.searchsorted(keys, length << _RANK_BITS | rank, "right") - 1
            _, first, sequence, each, offset = rows[segment].T if len(segment) else np.zeros((5, 0), np.int64)
            number = rank - first
            columns = dict(zip(batch.schema.names, batch.columns)) | {
                "sequence_id": pa.array(sequence + number // each),
                "offset": pa.array(offset + number % each * length),
            }
            del columns["rank"]
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    fields = [f for f in ranked.schema.fields if f.name != "rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return ranked.mapInArrow(find, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, *, capacity: int = 2048, keep: dict[str, Column] | None = None, **options) -> DataFrame:
    """Pieces of all documents with the sequence and the offset that each gets.

    ``keep={"ids": F.col("ids")}`` carries the ids along. An empty table gives no rows.
    """
    return place(pieces(docs, capacity=capacity, **options), capacity, keep)
