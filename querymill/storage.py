"""Storing an intermediate table where losing an executor cannot lose it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names; a fresh local one only in local mode."""
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get(_FOLDER, None) or conf.get(_FOLDER, None)
    if folder:
        return folder
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"Set {_FOLDER} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="querymill-")
    return _local_folders[app]


def store(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage, and gives later plans real sizes and column pruning.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
