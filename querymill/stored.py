"""Tables that are kept from run to run: bucketed by a key, and versions that become visible at once.

A bucketed table is laid out once; joins and groupings by its key then read it without a shuffle.
A version of a folder counts only once its commit is written, so a reader never sees half of one, and
a writer that is lost leaves nothing behind that counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of all rows from which on a key is kept apart: there are at most 1,000 such keys.
HOT_SHARE = 1000
#: Rows that a key must have at least to be kept apart, and parts that its rows are dealt to.
HOT_ROWS, SALTS = 100_000, 32


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    fs, place = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def complete(spark: SparkSession, path: str) -> bool:
    """Whether the job that wrote the folder has committed."""
    fs, place = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _fs(spark, path)
    fs.delete(place, True)


def commit(spark: SparkSession, path: str, version: int) -> None:
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/version={version}")


def committed(spark: SparkSession, path: str) -> list[int]:
    """Versions of a folder that count, oldest first."""
    found = [n for n in names(spark, f"{path}/commits") if n.startswith("version=")]
    return sorted(int(n.partition("=")[2]) for n in found if complete(spark, f"{path}/commits/{n}"))


def open_bucketed(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> str:
    """Name of the bucketed table at ``path``, made if there is none; a new session finds it again."""
    name = "bucketed_" + hashlib.md5(f"{path}|{buckets}".encode()).hexdigest()
    layout = f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet {layout} LOCATION '{path}'")
    spark.catalog.refreshTable(name)
    return name


def append_bucketed(df: DataFrame, name: str, key: str, buckets: int, deal: bool = True) -> None:
    """Add rows, one file per bucket; ``deal=False`` for rows that lie by bucket already."""
    dealt = df.repartition(buckets, key) if deal else df
    dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key).mode("append").saveAsTable(name)


def columns_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def store_bucketed(df: DataFrame, path: str, key: str, buckets: int, deal: bool = True) -> DataFrame:
    """Lay a table out once, bucketed and sorted by ``key``, and read it from there."""
    name = open_bucketed(df.sparkSession, path, columns_of(df), key, buckets)
    append_bucketed(df, name, key, buckets, deal)
    return df.sparkSession.table(name)


@dataclass
class Keyed:
    """A stored table by key: keys of ordinary size in buckets, rows of hot keys apart, unbucketed."""

    cold: DataFrame
    hot: DataFrame
    hot_keys: list
    key: str

    @property
    def rows(self) -> DataFrame:
        return self.cold.unionByName(self.hot) if self.hot_keys else self.cold

    def each(self, change: Callable[[DataFrame], DataFrame]) -> Keyed:
        """The same row-wise change to both parts; ordinary keys keep their buckets."""
        return Keyed(change(self.cold), change(self.hot), self.hot_keys, self.key)

    def stored(self, path: str, buckets: int) -> Keyed:
        """Both parts written, the ordinary keys in the buckets that they are read from."""
        cold = store_bucketed(self.cold, f"{path}/cold", self.key, buckets, deal=False)
        if not self.hot_keys:
            return Keyed(cold, cold.limit(0), [], self.key)
        self.hot.write.parquet(f"{path}/hot")
        return Keyed(cold, self.hot.sparkSession.read.schema(self.hot.schema).parquet(f"{path}/hot"), self.hot_keys, self.key)


def store_keyed(df: DataFrame, path: str, key: str, buckets: int, hot_rows: int = HOT_ROWS) -> Keyed:
    """Store ``df`` for joins and groupings by ``key``.

    A bucket is read by one task, so a key with more than ``hot_rows`` rows and more than a thousandth
    of the table would hold that task up. Such keys, a thousand at most, are kept in a table of their
    own and are joined and grouped by salted parts.
    """
    spark = df.sparkSession
    df.write.parquet(f"{path}/all")
    rows = spark.read.schema(df.schema).parquet(f"{path}/all")
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    least = max(hot_rows, rows.count() // HOT_SHARE)
    hot_keys = [r[0] for r in counts.where(F.col("n") > least).collect()]
    hot = is_hot(F.col(key), hot_keys)
    cold = store_bucketed(rows.where(~hot), f"{path}/cold", key, buckets)
    return Keyed(cold, rows.where(hot), hot_keys, key)


def is_hot(key: Column, hot_keys: list) -> Column:
    """True for hot keys, false for others and for null unless null is hot."""
    listed = [k for k in hot_keys if k is not None]
    found = F.coalesce(key.isin(listed), F.lit(False)) if listed else F.lit(False)
    return found | key.isNull() if None in hot_keys else found


def join_keyed(left: Keyed, right: DataFrame, how: str = "inner") -> Keyed:
    """Equi-join with a table stored in as many buckets by the same key: nothing is shuffled.

    Rows of hot keys are dealt to salted parts, and the right rows of these keys are repeated once per
    part. ``how`` is ``inner`` or ``left``.
    """
    cold = left.cold.join(right.hint("merge"), left.key, how)
    salt = F.pmod(F.xxhash64(*left.hot.columns), F.lit(SALTS))
    few = right.where(is_hot(F.col(left.key), left.hot_keys))
    parts = few.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    hot = left.hot.withColumn("__salt", salt).join(parts.hint("merge"), [left.key, "__salt"], how).drop("__salt")
    return Keyed(cold, hot, left.hot_keys, left.key)
