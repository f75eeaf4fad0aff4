"""Streams over the responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as Q
from checks.prep import new_path
from checks.registry import query, rounded
from checks.reward import REWARDED, SCORED
from checks.views import generations, raw_samples
from querymill.operators.prepare import filter_samples, preprocess
from querymill.operators.reward import store_schemas
from querymill.schemas import RAW, RESPONSE
from querymill.sources.corpus import stream_corpus
from querymill.streaming import rewards as streaming


BUCKETS = 16


def timed_responses(spark, sf_dir):
    """The responses with an event time."""
    seconds = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, sample_id)")
    return generations(spark, sf_dir).withColumn("ts", seconds)


def response_stream(spark, sf_dir):
    """The responses as files that arrive one by one, with an event time."""
    from pyspark.sql.types import StructType, TimestampType

    path = new_path(spark, "arriving")
    timed_responses(spark, sf_dir).write.parquet(path)
    schema = StructType([*RESPONSE.fields]).add("ts", TimestampType())
    return stream_corpus(spark, path, schema, files_per_trigger=3)


def _run(spark, stream, mode="append"):
    out, state = new_path(spark, "stream-out"), new_path(spark, "stream-state")
    streaming.write_available(stream, out, state, mode).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(
    "stream_scan_prepared",
    Q.with_(Q.PREP) + "SELECT sample_id, question, sql, complexity FROM kept",
)
def stream_scan(spark, sf_dir):
    path = new_path(spark, "raw")
    raw_samples(spark, sf_dir).write.parquet(path)
    prepared = filter_samples(preprocess(stream_corpus(spark, path, RAW, files_per_trigger=4)))
    return _run(spark, prepared.select("sample_id", "question", "sql", "complexity"))


@query(
    "stream_rewards",
    REWARDED + "SELECT sample_id, candidate, model, round(total, 6) AS total, round(reward, 6) AS reward FROM rewarded",
)
def stream_rewards(spark, sf_dir):
    """The schemas are laid out once; every micro-batch reads them by bucket."""
    schemas = store_schemas(raw_samples(spark, sf_dir), new_path(spark, "schemas"), BUCKETS)
    scored = streaming.score_stream(response_stream(spark, sf_dir), schemas=schemas)
    return rounded(
        _run(spark, scored.select("sample_id", "candidate", "model", "total", "reward"))
    )


_MONITOR = """, timed AS (SELECT *, sample_id // 600 AS slot FROM scored)
SELECT CAST(slot * 600 AS BIGINT) AS second, model, count(*) AS num_samples,
  round(100.0 * count(*) FILTER (valid) / count(*), 6)::DOUBLE AS valid_sql_pct, round(avg(total), 9) AS avg_reward,
  round(100.0 * count(*) FILTER (syntax > 0.5) / count(*), 6)::DOUBLE AS syntax_correct_pct,
  round(100.0 * count(*) FILTER (keywords > 0.5) / count(*), 6)::DOUBLE AS keyword_present_pct
FROM timed GROUP BY slot, model"""


def _monitored(df):
    second = F.expr("cast(unix_timestamp(interval_start) - unix_timestamp(timestamp'2024-01-01 00:00:00') as bigint)")
    return df.withColumn("second", second).drop("interval_start").select(
        "second", "model", "num_samples", F.round("valid_sql_pct", 6).alias("valid_sql_pct"),
        F.round("avg_reward", 9).alias("avg_reward"),
        F.round("syntax_correct_pct", 6).alias("syntax_correct_pct"),
        F.round("keyword_present_pct", 6).alias("keyword_present_pct"),
    )


@query("stream_reward_monitor", SCORED + _MONITOR)
def stream_monitor(spark, sf_dir):
    """The files arrive in any order; rows of any age add to their interval."""
    path = new_path(spark, "intervals")
    scored = streaming.score_stream(response_stream(spark, sf_dir))
    streaming.write_partials(scored, path, new_path(spark, "stream-state"), compact_after=3).awaitTermination()
    return _monitored(streaming.merged_intervals(spark, path))


@query("monitor_reward_intervals", SCORED + _MONITOR)
def monitor_batch(spark, sf_dir):
    from querymill.operators.reward import add_scores

    seconds = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, sample_id)")
    scored = add_scores(generations(spark, sf_dir).withColumn("ts", seconds))
    return _monitored(streaming.reward_monitor(scored))
