"""Corpora at rest: raw files, processed tables partitioned by split, limited and streamed scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from querymill.schemas import RAW
from querymill.operators.sampling import first_n
from querymill.sources.records import read_records

# As in ``results``: texts may hold line breaks, and nulls have a marker, so that an empty text stays one.
FIELDS = {
    "escape": '"', "nullValue": "\\N", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
CSV = {"header": True, **FIELDS}


def read_corpus(
    spark: SparkSession,
    path: str | list[str],
    split: str | None = None,
    fmt: str = "parquet",
    schema: StructType | None = RAW,
    **options: str | bool,
) -> DataFrame:
    """Raw samples with an explicit schema; columns a file lacks come out as null.

    In CSV files an unquoted empty field and ``\\N`` are null, a quoted empty field is an empty text,
    and quoted texts may hold line breaks. With a schema, many tasks read a large file
    (``records.read_records``, in which quotes are doubled). ``multiLine=True`` reads a file in one
    task, whatever its quotes; ``multiLine=False`` is for files known to have no line breaks in texts.
    """
    if fmt == "csv" and schema is not None and "multiLine" not in options:
        whole = schema if split is None or "split" in schema.fieldNames() else StructType([*schema.fields]).add("split", "string")
        df = read_records(spark, path, whole, **{**CSV, **options})
        return df if split is None else df.where(F.col("split") == split)
    csv = CSV if fmt == "csv" else {}
    reader = spark.read.format(fmt).options(**{**csv, **options})
    if schema is not None:
        if split is not None and "split" not in schema.fieldNames():
            schema = StructType([*schema.fields]).add("split", "string")
        reader = reader.schema(schema)
    df = reader.load(path)
    return df if split is None else df.where(F.col("split") == split)


def read_first(
    spark: SparkSession, path: str, n: int, split: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    """First n samples by id."""
    return first_n(read_corpus(spark, path, split, fmt), n)


def stream_corpus(
    spark: SparkSession, path: str, schema: StructType = RAW, fmt: str = "parquet",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """The same table as a stream; every row-wise operator runs on it unchanged.

    A micro-batch of few files would be read and worked on by as few tasks, so its rows are dealt to
    all cores first.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).repartition(spark.sparkContext.defaultParallelism)


def write_processed(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One directory per split, so that reading a split lists only its files."""
    df.write.partitionBy("split").mode(mode).parquet(path)


def read_processed(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def split_or_validation(df: DataFrame, wanted: str | None = None) -> DataFrame:
    """The wanted split if it has rows, else validation."""
    if wanted is None or df.where(F.col("split") == wanted).isEmpty():
        wanted = "validation"
    return df.where(F.col("split") == wanted)
