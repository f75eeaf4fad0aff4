"""Token files of directly addressable codes.

An id is split into 8-bit chunks. Level 0 holds the lowest chunk of every id, level 1 the next chunk
of those ids that have one, and so on; a bitmap beside each level tells which ids go on, and a rank
directory (ones before each 512 bits) finds their place in the next level. Any id is read with one
look-up per level, without decoding its neighbours.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querymill.llm import ids as token_ids
from querymill.llm.words import slices
from querymill.storage import shared_folder, store

MAGIC = b"DACIDS01"
BLOCK_WORDS = 8  # 512 bits between entries of the rank directory
#: Ids per file; a longer document still goes into one file.
FILE_IDS = 8_000_000
MANIFEST = "file string, part int, number int, n_docs long, n_ids long"


class Codes:
    """Directly addressable codes of an array of unsigned 32-bit ids."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int):
        self.levels, self.n = levels, n

    @classmethod
    def encode(cls, ids: np.ndarray) -> Codes:
        levels, rest = [], np.asarray(ids, np.uint32)
        while len(rest):
            more = rest > 0xFF
            bits = np.packbits(more, bitorder="little")
            words = np.zeros(-(-len(rest) // (64 * BLOCK_WORDS)) * BLOCK_WORDS, np.uint64)
            words.view(np.uint8)[: len(bits)] = bits
            ones = np.bitwise_count(words).reshape(-1, BLOCK_WORDS).sum(1, dtype=np.uint64)
            levels.append(((rest & 0xFF).astype(np.uint8), words, np.cumsum(ones) - ones))
            rest = rest[more] >> np.uint32(8)
        return cls(levels, len(ids))

    def get(self, positions: np.ndarray) -> np.ndarray:
        """Ids at any positions."""
        at = np.asarray(positions, np.int64)
        out, open_, shift = np.zeros(len(at), np.uint32), np.arange(len(at)), 0
        for chunks, words, ranks in self.levels:
            out[open_] |= chunks[at].astype(np.uint32) << np.uint32(shift)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            go = (words[word] >> bit) & np.uint64(1) == 1
            open_, at, word, bit = open_[go], at[go], word[go], bit[go]
            if not len(at):
                break
            block = word // BLOCK_WORDS
            rank = ranks[block].astype(np.int64)
            rank += np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            for i in range(BLOCK_WORDS - 1):
                before = block * BLOCK_WORDS + i
                rank += np.where(before < word, np.bitwise_count(words[before]), 0)
            at, shift = rank, shift + 8
        return out

    def all(self) -> np.ndarray:
        """All ids, from the last level up."""
        value = np.zeros(0, np.uint32)
        for chunks, words, _ in reversed(self.levels):
            more = np.unpackbits(words.view(np.uint8), bitorder="little", count=len(chunks)).astype(bool)
            full = chunks.astype(np.uint32)
            full[more] |= value << np.uint32(8)
            value = full
        return value

    def blocks(self) -> Iterator[bytes]:
        yield struct.pack("<QQ", self.n, len(self.levels))
        for chunks, words, ranks in self.levels:
            yield struct.pack("<QQQ", len(chunks), len(words), len(ranks))
            yield from (chunks.tobytes(), words.tobytes(), ranks.tobytes())


class TokenFile:
    """One file: ids of its documents, where each begins, and the codes of all of them."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("Not a file of directly addressable codes")
        self._data, self._at = data, 8
        (n,) = self._take("<Q")
        self.doc_ids, self.has_id = self._array(np.int64, n), self._array(np.uint8, n).astype(bool)
        self.starts = self._array(np.int64, n + 1)
        total, n_levels = self._take("<QQ")
        levels = []
        for _ in range(n_levels):
            sizes = self._take("<QQQ")
            levels.append(tuple(self._array(t, k) for t, k in zip((np.uint8, np.uint64, np.uint64), sizes)))
        self.codes = Codes(levels, total)

    def _take(self, form: str) -> tuple:
        out = struct.unpack_from(form, self._data, self._at)
        self._at += struct.calcsize(form)
        return out

    def _array(self, kind, n: int) -> np.ndarray:
        out = np.frombuffer(self._data, kind, n, self._at)
        self._at += out.nbytes
        return out

    @staticmethod
    def blocks(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> Iterator[bytes]:
        yield MAGIC + struct.pack("<Q", len(doc_ids))
        yield np.array([d or 0 for d in doc_ids], np.int64).tobytes()
        yield np.array([d is not None for d in doc_ids], np.uint8).tobytes()
        yield np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64).tobytes()
        yield from Codes.encode(ids).blocks()


def read_file(path: str) -> TokenFile:
    files, inner = pafs.FileSystem.from_uri(path)
    with files.open_input_stream(inner) as f:
        return TokenFile(f.read())


def _write_file(folder: str, name: str, blocks: Iterator[bytes]) -> str:
    """Under a name of its own first, so that a lost or repeated task leaves no half file."""
    files, inner = pafs.FileSystem.from_uri(folder)
    files.create_dir(inner, recursive=True)
    draft = f"{inner}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as f:
        for block in blocks:
            f.write(block)
    files.move(draft, f"{inner}/{name}")
    return f"{folder}/{name}"


def write(
    docs: DataFrame,
    folder: str,
    *,
    vocabulary: str | None = None,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Encode every text, append ``end_id``, write files in ascending order of ``id_col``.

    Returns the manifest, one row per file in (part, number) order. A null text is the end id
    alone, null ids come first, equal ids are ordered by text, and other columns are ignored. An
    empty table writes no file. ``folder`` must be reachable from all executors.
    """
    path = vocabulary or token_ids.vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        doc_ids, sizes, parts, total = [], [], [], 0
        encoder = token_ids.encoder(path)

        def flush() -> pa.RecordBatch:
            nonlocal number, doc_ids, sizes, parts, total
            blocks = TokenFile.blocks(doc_ids, sizes, np.concatenate(parts))
            file = _write_file(folder, f"part-{part:06d}-{number:05d}.dac", blocks)
            row = pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                 pa.array([len(doc_ids)], pa.int64()), pa.array([total], pa.int64())],
                names=["file", "part", "number", "n_docs", "n_ids"],
            )
            doc_ids, sizes, parts, total, number = [], [], [], 0, number + 1
            return row

        for batch in batches:
            for piece in slices(batch, 1):
                flat, at = encoder.encode(piece.column(1))
                for i, doc in enumerate(piece.column(0).to_pylist()):
                    own = at[i + 1] - at[i]
                    if total and total + own + 1 > file_ids:
                        yield flush()
                    doc_ids.append(doc)
                    sizes.append(own + 1)
                    parts += [flat[at[i] : at[i + 1]], np.array([end_id], np.uint32)]
                    total += own + 1
        if doc_ids:
            yield flush()

    ordered = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).repartitionByRange("i")
    return store(ordered.sortWithinPartitions("i", "t").mapInArrow(encode, MANIFEST), "token-files")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Documents of the files: doc_id, start (ids before it), n_tokens, ids (little-endian bytes).

    The running total goes over the manifest, one narrow row per file.
    """
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = read_file(file)
                ids, starts = f.codes.all(), f.starts
                for a in range(0, len(f.doc_ids), 1000):
                    b = min(a + 1000, len(f.doc_ids))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(f.doc_ids[a:b], mask=~f.has_id[a:b]), pa.array(starts[a:b] + before),
                         pa.array(starts[a + 1 : b + 1] - starts[a:b]),
                         pa.array([ids[x:y].astype("<u4").tobytes() for x, y in zip(starts[a:b], starts[a + 1 : b + 1])], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    n = max(1, manifest.count())
    return files.repartition(n).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def tokens_at(spark: SparkSession, manifest: DataFrame, positions: DataFrame) -> DataFrame:
    """Ids at global positions (column ``position``), read by rank look-ups in the files.

    Positions find their file by a join on ranges of ids: each file's range is cut into steps of
    the smallest power of two that holds ``FILE_IDS``, so a position meets few files.
    """
    step = 1 << (FILE_IDS - 1).bit_length()
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(order), F.lit(0))).withColumn(
        "step", F.explode(F.sequence(F.floor(F.col("first") / step), F.floor((F.col("first") + F.col("n_ids") - 1) / step)))
    )
    wanted = positions.select(F.col("position").cast("long")).withColumn("step", F.floor(F.col("position") / step))
    met = wanted.join(files, "step").where("position >= first and position < first + n_ids")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, opened = None, None
        for batch in batches:
            file, first, position = (np.array(batch.column(i).to_pylist(), object if i == 0 else np.int64) for i in range(3))
            for f in dict.fromkeys(file):
                if f != name:
                    name, opened = f, read_file(f)
                own = file == f
                ids = opened.codes.get(position[own] - first[own])
                yield pa.RecordBatch.from_arrays([pa.array(position[own]), pa.array(ids.astype(np.int64))], names=["position", "id"])

    return met.select("file", "first", "position").sortWithinPartitions("file").mapInArrow(look, "position long, id long")


def digest(documents: DataFrame) -> DataFrame:
    """The read-back documents with a checksum in place of their ids."""
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def write_and_read(docs: DataFrame, **options) -> DataFrame:
    """``write`` into a new folder of the shared place, then ``read``."""
    spark = docs.sparkSession
    manifest = write(docs, f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}", **options)
    return read(spark, manifest)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
