"""Streams equal batches; clean-up of generated texts."""

from pyspark.sql import functions as F

from checks import streams
from checks.views import generations, raw_samples
from querymill.operators import generate, reward
from querymill.sources.corpus import stream_corpus
from querymill.streaming import rewards as streaming


def timed(spark, sf):
    ts = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, sample_id)")
    return generations(spark, sf).withColumn("ts", ts)


def test_stream_scores_equal_batch(spark, sf, tmp_path):
    df = timed(spark, sf)
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = stream_corpus(spark, str(tmp_path / "in"), df.schema, files_per_trigger=2)
    scored = streaming.score_stream(stream, raw_samples(spark, sf)).select("sample_id", "candidate", "reward")
    query = streaming.write_available(scored, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    batch = reward.rewards(df, raw_samples(spark, sf)).select("sample_id", "candidate", "reward")
    assert out.count() == batch.count() and out.exceptAll(batch).isEmpty()


def test_append_monitor_emits_closed_intervals(spark, sf, tmp_path):
    df = timed(spark, sf).where("sample_id < 600")
    for i in range(3):
        part = df.where(f"sample_id div 200 = {i}")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stream_corpus(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)
    monitored = streaming.reward_monitor(streaming.score_stream(stream), "100 seconds", "50 seconds")
    query = streaming.write_available(monitored, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    batch = streaming.reward_monitor(reward.add_scores(df), "100 seconds", "50 seconds")
    closed = batch.where("interval_start < timestamp'2024-01-01 00:08:20'")
    columns = ["interval_start", "model", "num_samples", "valid_sql_pct"]
    want = {tuple(r) for r in closed.select(*columns).collect()}
    assert {tuple(r) for r in out.select(*columns).collect()} == want and len(want) == 10


def test_updated_intervals_hold_everything(spark, sf, tmp_path):
    df = timed(spark, sf)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = stream_corpus(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)
    monitored = streaming.reward_monitor(streaming.score_stream(stream), lateness="30 days")
    streaming.write_intervals(monitored, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    last = streaming.latest_intervals(spark, str(tmp_path / "out"))
    assert last.agg(F.sum("num_samples")).first()[0] == df.count()
    assert last.groupBy("interval_start", "model").count().where("count > 1").isEmpty()


def test_monitor_keeps_rows_however_far_apart(spark, sf, monkeypatch):
    """Timestamps span about a year, the latest are in the first files."""
    far = generations(spark, sf).withColumn("sample_id", F.col("sample_id") * 5000)
    far = far.repartitionByRange(24, F.desc("sample_id")).cache()
    monkeypatch.setattr(streams, "generations", lambda *_: far)
    seen = streams.stream_monitor(spark, sf)
    assert seen.agg(F.sum("num_samples")).first()[0] == far.count()
    want = streams.monitor_batch(spark, sf)
    assert seen.count() == want.count() and seen.exceptAll(want).isEmpty()


def test_full_lateness(spark):
    given = spark.sql("SELECT timestamp'2024-01-01 00:00:00.5' + make_interval(0, 0, 0, 0, 0, 0, id * 4000000) AS ts FROM range(3)")
    assert streaming.full_lateness(given) == "8000001 seconds"
    assert streaming.full_lateness(given.limit(0)) == "0 seconds"


def test_state_holds_open_intervals_only(spark, sf, tmp_path):
    df = timed(spark, sf).where("sample_id < 1000")
    for i in range(5):
        df.where(f"sample_id div 200 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stream_corpus(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)
    monitored = streaming.reward_monitor(streaming.score_stream(stream), "100 seconds", "50 seconds")
    query = streaming.write_intervals(monitored, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    rows = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    # Ten intervals of two models in all, of which at most three are open at a time.
    assert max(rows) <= 8
    assert streaming.latest_intervals(spark, str(tmp_path / "out")).agg(F.sum("num_samples")).first()[0] == df.count()


def test_stop_sequences(evaluate_expr):
    texts = ["a b", "xab", "one.two|three", ""]
    assert evaluate_expr(texts, lambda c: generate.until_stop(c, ("ab", "b", "."))) == ["a ", "x", "one", ""]
    assert evaluate_expr(["a"], lambda c: generate.until_stop(c, ())) == ["a"]


def test_echo(evaluate_expr):
    got = evaluate_expr(["p: x", "other", " p: y "], lambda c: generate.without_echo(c, F.lit("p: ")))
    assert got == ["x", "other", "p: y"]


def test_a_batch_of_one_file_is_worked_on_by_all_cores(spark, tmp_path):
    from querymill.sources.corpus import stream_corpus

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stream_corpus(spark, str(tmp_path / "in"), spark.range(1).schema, files_per_trigger=1)
    parts = []
    query = stream.writeStream.foreachBatch(lambda batch, i: parts.append((batch.rdd.getNumPartitions(), batch.count())))
    query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert parts == [(spark.sparkContext.defaultParallelism, 100)]
