"""CSV files with line breaks in quoted texts, read by many tasks per file.

A line break ends a record where the quotes so far are even. A first pass counts the quotes of each
block of a file; their parities, added up along the file, tell for every block whether it begins inside
a quoted text. Where a block begins outside of one and every line has an even number of quotes, every
line is a record, and the second pass reads it so. In the other blocks it places the record breaks;
records of one line are parsed as they are, only lines of longer records are brought together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from querymill.storage import store

#: How a text line is named: its file, the block of the file that a task reads, its place there.
PLACE = ["__file", "__block", "__place"]


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their places and quotes. ``\\r`` stays part of a line."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__place"),
        F.col("value").alias("__line"),
    ).withColumn("__quotes", F.octet_length("__line") - F.octet_length(F.replace("__line", F.lit('"'), F.lit(""))))


def _blocks(lines: DataFrame) -> DataFrame:
    """Per block: quotes before it in its file, modulo 2, its first line, and whether its lines are records.

    A block has one row here; files have as many as they have tasks.
    """
    counted = lines.groupBy("__file", "__block").agg(
        F.sum("__quotes").alias("__in_block"),
        F.count_if(F.col("__quotes") % 2 == 1).alias("__odd"),
        F.min("__place").alias("__top"),
        F.count("*").alias("__lines"),
    )
    before = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    parity = F.coalesce(F.sum("__in_block").over(before), F.lit(0)) % 2
    whole = (F.col("__odd") == 0) & (F.col("__parity") == 0)
    return counted.select("__file", "__block", "__top", "__lines", "__odd", parity.alias("__parity")).withColumn("__whole", whole)


def record_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``__file, __first, __record``: the text of every record; ``__first`` for the first of its file."""
    lines, own = _lines(spark, path), ["__file", "__block"]
    blocks = store(_blocks(lines), "blocks")
    first = (F.col("__block") == 0) & (F.col("__place") == F.col("__top"))
    found = lines.join(F.broadcast(blocks), own).withColumn("__first", first)
    counts = {r["__whole"]: r["n"] for r in blocks.groupBy("__whole").agg(F.sum("__lines").alias("n")).collect()}
    plain = found.where("__whole").select("__file", "__first", F.col("__line").alias("__record"))
    plain = _complete(store(plain, "records"), counts.get(True, 0))
    return plain.unionByName(_mixed(found.where("NOT __whole"), counts[False])) if False in counts else plain


def _complete(lines: DataFrame, expected: int) -> DataFrame:
    """Both passes must see the same blocks; where a cluster grows in between, Spark may cut files elsewhere."""
    if lines.count() != expected:
        raise RuntimeError("The files were cut into other blocks, or changed, while they were read")
    return lines


def _mixed(placed: DataFrame, expected: int) -> DataFrame:
    """The records of blocks with lines that are not records of their own."""
    own = ["__file", "__block"]
    in_block = Window.partitionBy(*own).orderBy("__place")
    upto = in_block.rowsBetween(Window.unboundedPreceding, -1)
    quotes = F.coalesce(F.sum("__quotes").over(upto), F.lit(0)) + F.col("__parity")
    # a block is one task's share of a file, so these windows are as large as a scan task
    placed = placed.withColumn("__begins", quotes % 2 == 0)
    ends = F.lead("__begins", 1).over(in_block)  # null for the last line of a block
    begun = F.last(F.when(F.col("__begins"), F.col("__place")), ignorenulls=True).over(in_block)
    marked = placed.withColumns({"__ends": ends, "__begun": begun})
    marked = store(marked.select(*PLACE, "__line", "__begins", "__ends", "__begun", "__first"), "lines")
    _complete(marked, expected)

    whole = F.col("__begins") & F.coalesce(F.col("__ends"), F.lit(False))
    single = marked.where(whole).select("__file", "__first", F.col("__line").alias("__record"))

    # lines of longer records, and the last line of each block: a later block may go on with it
    rest = marked.where(~whole)
    heads = rest.where(F.col("__begun").isNull()).select(*own).distinct()
    last = rest.where("__ends IS NULL").groupBy(*own).agg(F.max("__begun").alias("__last"))
    earlier = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    spot = F.when(F.col("__last").isNotNull(), F.struct(F.col("__block").alias("block"), F.col("__last").alias("place")))
    carried = last.withColumn("__from", F.last(spot, ignorenulls=True).over(earlier))
    carried = carried.join(heads, own, "left_semi").select(*own, "__from")
    here = F.struct(F.col("__block").alias("block"), F.col("__begun").alias("place"))
    keyed = rest.join(carried.hint("merge"), own, "left").withColumn(
        "__key", F.when(F.col("__begun").isNull(), F.col("__from")).otherwise(here)
    )
    ordered = F.array_sort(F.collect_list(F.struct("__block", "__place", "__line")))
    joined = F.array_join(F.transform(ordered, lambda x: x["__line"]), "\n")
    longer = keyed.groupBy("__file", "__key").agg(F.max("__first").alias("__first"), joined.alias("__record"))
    return single.unionByName(longer.select("__file", "__first", "__record"))


def read_records(
    spark: SparkSession, path: str | list[str], schema: StructType, header: bool = True, **options: str | bool
) -> DataFrame:
    """Rows of CSV files in which quotes inside quoted texts are doubled.

    Columns go by position in ``schema``, as for a reader with a given schema. Blank lines are no
    records; a file without rows gives none. A quote inside an unquoted field would be taken for the
    begin of a quoted one; such files need ``read_corpus(..., multiLine=True)``.
    """
    records = record_texts(spark, path)
    if header:
        records = records.where(~F.col("__first"))
    text = F.when(F.contains("__record", F.lit("\r")), F.regexp_replace("__record", "\r$", "")).otherwise(F.col("__record"))
    parsed = F.from_csv(text, _flat(schema), {k: str(v) for k, v in options.items()})
    return records.where(text.rlike("[^ \t\r\n]")).select(parsed.alias("__row")).select("__row.*")


def _flat(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
