"""Exact line deduplication against levelled sorted runs of line hashes.

Texts are cut into lines and hashed in one scan, stored by batch of ascending ids. Each batch's distinct line hashes are merge-anti-joined
with the runs, which are bucketed and sorted tables of one file per bucket, so that they are neither
shuffled nor sorted for it; what is new becomes a run of level 0. A level that has ``FANOUT`` runs is
compacted into one run of the next level by merge joins bucket by bucket, without a shuffle; the new
run is sorted within its buckets as it is written, and the files of the old ones are deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.llm.names import put_back, set_aside
from querymill.storage import shared_folder, store

#: Runs of a level before they are compacted.
FANOUT = 2
HASH = ["h1", "h2"]
#: Lets plans use the order within buckets of one file each.
ORDERED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"
WORKING = ("_doc", "_gone", "_lines")
#: White space stripped from both ends of a line.
STRIPPED = " \t\n\x0b\x0c\r"


def line_key(bare: Column) -> Column:
    """A line without outer white space, A-Z lower-cased. Lines of ASCII alone take the cheaper function."""
    plain = F.octet_length(bare) == F.char_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@contextmanager
def ordered_buckets(spark: SparkSession) -> Iterator[None]:
    """Plans made inside read bucketed tables in their order."""
    before = spark.conf.get(ORDERED_BUCKETS, None)
    spark.conf.set(ORDERED_BUCKETS, "true")
    try:
        yield
    finally:
        spark.conf.unset(ORDERED_BUCKETS) if before is None else spark.conf.set(ORDERED_BUCKETS, before)


class LineRuns:
    """Hashes of lines seen so far with the smallest id that holds each.

    Runs are tables of a database of their own, whose place is the shared folder.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self._spark = spark
        self._buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._database = f"line_runs_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {self._database} LOCATION '{shared_folder(spark)}/{self._database}'")
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame) -> str:
        """A run from rows that are already laid out by bucket, or are dealt anew where they are not."""
        name = f"{self._database}.run_{uuid.uuid4().hex}"
        with ordered_buckets(self._spark):
            rows.write.bucketBy(self._buckets, *HASH).sortBy(*HASH).saveAsTable(name)
        return name

    @property
    def runs(self) -> list[DataFrame]:
        return [self._spark.table(n) for level in self.levels for n in level]

    def owners(self, first: DataFrame) -> DataFrame:
        """The earlier owner of those hashes of a batch (h1, h2, ...) that some run holds.

        A hash is in one run at most, because each batch adds only what is new.
        """
        with ordered_buckets(self._spark):
            found = [store(first.hint("merge").join(run.withColumnRenamed("owner", "earlier"), HASH), "owners") for run in self.runs]
        out = found[0]
        for part in found[1:]:
            out = out.unionByName(part)
        return out

    def add(self, first: DataFrame) -> None:
        """Add what a batch (h1, h2, owner) has beyond the runs, and compact full levels."""
        new = first.select(*HASH, "owner").repartition(self._buckets, *HASH)
        for run in self.runs:
            new = new.hint("merge").join(run.select(*HASH), HASH, "left_anti")
        name, level = self._write(new), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < FANOUT:
                return
            full = self.levels[level]
            name = self._write(self.merged(full))
            self._drop(full)
            self.levels[level], level = [], level + 1

    def merged(self, names: list[str]) -> DataFrame:
        """The rows of several runs, merged bucket by bucket; no hash is in two of them."""
        out = self._spark.table(names[0])
        for n in names[1:]:
            other = self._spark.table(n).withColumnRenamed("owner", "other")
            out = out.hint("merge").join(other, HASH, "full_outer").select(*HASH, F.coalesce("owner", "other").alias("owner"))
        return out

    def _drop(self, names: list[str]) -> None:
        for n in names:
            self._spark.sql(f"DROP TABLE {n}")

    def close(self) -> None:
        """Forget the runs and delete their files."""
        self._drop([n for level in self.levels for n in level])
        self._spark.sql(f"DROP DATABASE {self._database}")
        self.levels = []


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Keyed lines (batch, doc, position, h1, h2)."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    exploded = docs.select("batch", "doc", F.posexplode(lines).alias("position", "line"))
    # Lower-casing keeps the number of code points, so that short lines need none.
    bare = exploded.withColumn("line", F.btrim("line", F.lit(STRIPPED))).where(F.length("line") >= min_chars)
    key = line_key(F.col("line"))
    return bare.select("batch", "doc", "position", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def _store_by_batch(lines: DataFrame) -> DataFrame:
    """The lines, stored with a folder for each batch, so that a batch reads its own only."""
    path = f"{shared_folder(lines.sparkSession)}/keyed-lines-{uuid.uuid4().hex}"
    lines.write.partitionBy("batch").parquet(path)
    return lines.sparkSession.read.schema(lines.schema).parquet(path)


def repeated_lines(docs: DataFrame, *, min_chars: int = 10, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines to drop: (doc, position) of each keyed line that a smaller id holds as well; stored.

    Documents without an id take no part. Batches are ranges of ids of about equal size.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    cuts = own.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + (F.col("doc") > cut).cast("int")
    keyed = _store_by_batch(_lines(own.withColumn("batch", batch), min_chars))
    runs, dropped = LineRuns(spark), []
    for number in range(len(cuts) + 1):
        lines = keyed.where(F.col("batch") == number).drop("batch")
        # Partial aggregation leaves a very common line with one row per task.
        first = store(lines.groupBy(*HASH).agg(F.min("doc").alias("owner"), F.max("doc").alias("last")), "first-lines")
        shared = first.where("owner < last").select(*HASH, "owner")
        if runs.runs:
            earlier = runs.owners(first).select(*HASH, F.col("earlier").alias("owner"))
            shared = earlier.unionByName(shared.hint("merge").join(earlier.select(*HASH), HASH, "left_anti"))
        if number < len(cuts):
            runs.add(first)
        dropped.append(store(lines.hint("merge").join(shared, HASH).where("doc <> owner").select("doc", "position"), "dropped-lines"))
    runs.close()
    out = dropped[0]
    for part in dropped[1:]:
        out = out.unionByName(part)
    return out


def dedup(
    docs: DataFrame,
    *,
    min_chars: int = 10,
    batches: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    chars_col: str | None = "n_chars",
) -> DataFrame:
    """Documents with all columns and without lines that a document of smaller id holds.

    Adds n_lines (before) and n_dropped. Within its smallest document a line stays as often as it
    stands there; rows with the same id are one document. A null text is kept as null and counts
    one line; documents without an id stay as they are. Ids are whole numbers. ``chars_col``, if
    there, follows the text. Input columns named like an added one are replaced.
    """
    docs, moved = set_aside(docs, WORKING)
    id_col, text_col, chars_col = (moved.get(c, c) for c in (id_col, text_col, chars_col))
    gone = repeated_lines(docs, min_chars=min_chars, batches=batches, id_col=id_col, text_col=text_col)
    lists = gone.groupBy(F.col("doc").alias("_doc")).agg(F.array_sort(F.collect_set("position")).alias("_gone"))
    joined = docs.hint("merge").join(lists, F.col(id_col).cast("long") == F.col("_doc"), "left").drop("_doc")
    lines = F.split(F.coalesce(text_col, F.lit("")), "\n", -1)
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone"), lambda i: F.get("_lines", i)
    )
    rest = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumn("_lines", lines).withColumns(
        {
            "n_lines": F.size("_lines").cast("long"),
            "n_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"),
            text_col: rest,
        }
    )
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col("_gone").isNull(), F.col(chars_col)).otherwise(F.length(text_col)).cast(docs.schema[chars_col].dataType))
    return put_back(out.drop(*WORKING), moved)
