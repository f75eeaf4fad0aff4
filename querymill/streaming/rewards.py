"""Scoring responses as they arrive and monitoring the rewards per interval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from querymill import stored
from querymill.functions.extraction import ParserOptions, valid_format
from querymill.functions.rubric import RubricOptions
from querymill.operators.columns import percent
from querymill.operators.reward import rewards


def score_stream(
    responses: DataFrame,
    samples: DataFrame | None = None,
    opts: RubricOptions = RubricOptions(),
    schemas: DataFrame | None = None,
) -> DataFrame:
    """The batch operator on a stream; ``samples`` is a static table (stream-static join).

    Every micro-batch would parse and shuffle ``samples`` again. ``schemas``, laid out once by
    ``operators.reward.store_schemas``, is read by bucket in place.
    """
    return rewards(responses, samples, opts=opts, schemas=schemas)


def reward_monitor(
    scored: DataFrame,
    interval: str = "10 minutes",
    lateness: str = "10 minutes",
    by: Sequence[str] = ("model",),
    ts: str = "ts",
    parser: ParserOptions = ParserOptions(),
) -> DataFrame:
    """Step statistics per tumbling interval. State holds one row per open interval and group."""
    sql = F.col("extracted_sql")
    valid = sql.isNotNull() & valid_format(F.col("response"), sql, parser)
    everything = F.count("*")
    source = scored.withWatermark(ts, lateness) if scored.isStreaming else scored
    return (
        source.groupBy(F.window(ts, interval).alias("interval"), *by)
        .agg(
            everything.alias("num_samples"),
            percent(F.count_if(valid), everything).alias("valid_sql_pct"),
            F.avg("total").alias("avg_reward"),
            percent(F.count_if(F.col("syntax") > 0.5), everything).alias("syntax_correct_pct"),
            percent(F.count_if(F.col("keywords") > 0.5), everything).alias("keyword_present_pct"),
        )
        .select(
            F.col("interval.start").alias("interval_start"),
            *by,
            "num_samples",
            "valid_sql_pct",
            "avg_reward",
            "syntax_correct_pct",
            "keyword_present_pct",
        )
    )


def full_lateness(given: DataFrame, ts: str = "ts") -> str:
    """The lateness with which no row of a table at rest is dropped, in whatever order it arrives.

    It is the span of the timestamps, so all intervals stay open: one state row per interval and group.
    """
    span = given.agg(F.ceil(F.max(F.unix_micros(ts)) / 1e6) - F.floor(F.min(F.unix_micros(ts)) / 1e6)).first()[0]
    return f"{span or 0} seconds"


#: What a batch keeps of an interval: sums that add up to the step statistics.
PARTIAL = ("num_samples", "num_valid", "num_syntax", "num_keywords", "sum_reward")
#: Batches that are merged into one table when so many have come since the last time.
COMPACT_AFTER = 50


def partial_statistics(
    scored: DataFrame, interval: str = "10 minutes", by: Sequence[str] = ("model",), ts: str = "ts",
    parser: ParserOptions = ParserOptions(),
) -> DataFrame:
    """Counts and sums per tumbling interval; those of several batches add up."""
    sql = F.col("extracted_sql")
    valid = sql.isNotNull() & valid_format(F.col("response"), sql, parser)
    sums = [
        F.count("*").alias("num_samples"),
        F.count_if(valid).alias("num_valid"),
        F.count_if(F.col("syntax") > 0.5).alias("num_syntax"),
        F.count_if(F.col("keywords") > 0.5).alias("num_keywords"),
        F.sum("total").alias("sum_reward"),
    ]
    grouped = scored.groupBy(F.window(ts, interval).alias("interval"), *by).agg(*sums)
    return grouped.select(F.col("interval.start").alias("interval_start"), *by, *PARTIAL)


def write_partials(
    scored: DataFrame, path: str, checkpoint: str, interval: str = "10 minutes",
    by: Sequence[str] = ("model",), ts: str = "ts", compact_after: int = COMPACT_AFTER,
) -> StreamingQuery:
    """Process what is there, writing the sums of each batch beside those of earlier ones.

    There is no watermark and no operator state: a row of any age adds to its interval. A repeated
    batch overwrites its own folder. ``merged_intervals`` reads the current values; many batches are
    merged into one table from time to time.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = partial_statistics(batch, interval, by, ts)
        batch.write.mode("overwrite").parquet(f"{path}/batches/batch={batch_id}")
        done = max(stored.committed(batch.sparkSession, path), default=-1)
        if batch_id - done >= compact_after:
            compact_partials(batch.sparkSession, path, by)

    return (
        scored.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _partials(spark: SparkSession, path: str) -> tuple[DataFrame | None, list[int], list[int]]:
    """Sums to add up, the batches among them, and the committed merges."""
    merges = stored.committed(spark, path)
    done = max(merges, default=-1)
    found = [int(n.partition("=")[2]) for n in stored.names(spark, f"{path}/batches") if n.startswith("batch=")]
    batches = sorted(b for b in found if b > done and stored.complete(spark, f"{path}/batches/batch={b}"))
    folders = [f"{path}/merged/upto={done}"] * bool(merges) + [f"{path}/batches/batch={b}" for b in batches]
    return (spark.read.parquet(*folders) if folders else None), batches, merges


def _added(partials: DataFrame, by: Sequence[str]) -> DataFrame:
    return partials.groupBy("interval_start", *by).agg(*[F.sum(c).alias(c) for c in PARTIAL])


def merged_intervals(spark: SparkSession, path: str, by: Sequence[str] = ("model",)) -> DataFrame:
    """Step statistics of every interval and group over all batches so far."""
    partials, _, _ = _partials(spark, path)
    if partials is None:
        raise ValueError(f"No batch has been written to {path}")
    everything = F.col("num_samples")
    return _added(partials, by).select(
        "interval_start",
        *by,
        "num_samples",
        percent(F.col("num_valid"), everything).alias("valid_sql_pct"),
        (F.col("sum_reward") / everything).alias("avg_reward"),
        percent(F.col("num_syntax"), everything).alias("syntax_correct_pct"),
        percent(F.col("num_keywords"), everything).alias("keyword_present_pct"),
    )


def compact_partials(spark: SparkSession, path: str, by: Sequence[str] = ("model",)) -> None:
    """Merge the batches so far into one table.

    It counts from its commit on, in one step. Only files that the merge before had replaced are
    deleted, so a read that is under way keeps its files.
    """
    partials, batches, merges = _partials(spark, path)
    if not batches:
        return
    _added(partials, by).write.mode("overwrite").parquet(f"{path}/merged/upto={batches[-1]}")
    stored.commit(spark, path, batches[-1])
    for old in merges[:-1]:
        stored.remove(spark, f"{path}/merged/upto={old}")
        stored.remove(spark, f"{path}/commits/version={old}")
    for name in stored.names(spark, f"{path}/batches") if merges else []:
        if int(name.partition("=")[2]) <= merges[-1]:
            stored.remove(spark, f"{path}/batches/{name}")


def write_available(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet"
) -> StreamingQuery:
    """Process what is there and stop. The checkpoint folder must be shared on a cluster."""
    return (
        stream.writeStream.format(fmt)
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_intervals(monitored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, writing after every batch only the intervals that it changed.

    Update mode: the state holds the intervals that are still open under the watermark, and a
    repeated batch overwrites its own folder. ``latest_intervals`` reads the current values.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        monitored.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_intervals(
    spark: SparkSession, path: str, by: Sequence[str] = ("model",)
) -> DataFrame:
    """The last values written for every interval and group."""
    written = spark.read.parquet(path)
    keys = ["interval_start", *by]
    values = [c for c in written.columns if c not in (*keys, "batch")]
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return last.select(*keys, "last.*")
