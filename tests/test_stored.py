"""Stored layouts, the score store, partial sums of a stream."""

import pytest
from pyspark.sql import functions as F

from checks.views import generations, raw_samples
from querymill import stored
from querymill.functions.rubric import RubricOptions
from querymill.operators import reward
from querymill.operators.score_store import NAMES, ScoreStore
from querymill.plans import jobs
from querymill.sources.corpus import stream_corpus
from querymill.streaming import rewards as streaming


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


# score store


def test_second_run_scores_nothing(spark, sf, tmp_path):
    texts = generations(spark, sf)
    first, again = ScoreStore(spark, str(tmp_path / "s"), 4), ScoreStore(spark, str(tmp_path / "s"), 4)
    distinct = texts.select(F.coalesce("response", F.lit(""))).distinct().count()
    assert first.add(texts.where("candidate = 0")) < distinct
    first.add(texts)
    assert first.scores.count() == distinct
    assert again.add(texts) == 0 and again.scores.count() == distinct
    want = reward.add_scores(texts)
    columns = ["sample_id", "candidate", *NAMES]
    assert rows_of(again.score(texts), *columns) == rows_of(want, *columns)


def test_other_options_are_other_scores(spark, tmp_path):
    store = ScoreStore(spark, str(tmp_path / "s"), 2)
    texts = spark.createDataFrame([("SELEC a",), (None,), ("",), ("SELECT a FROM t",), ("SELECT a FROM t",)], "response string")
    strict = RubricOptions(strict_mode=True)
    assert store.add(texts) == 3 and store.add(texts, opts=strict) == 3
    for opts in (RubricOptions(), strict):
        assert rows_of(store.score(texts, opts=opts), "response", "total") == rows_of(reward.add_scores(texts, opts=opts), "response", "total")
    assert store.add(texts.limit(0)) == 0 and store.score(texts.limit(0)).count() == 0


def test_store_is_read_by_bucket_and_rewritten(spark, tmp_path, monkeypatch):
    from querymill.operators import score_store

    monkeypatch.setattr(score_store, "REWRITE_AFTER", 2)
    store = ScoreStore(spark, str(tmp_path / "s"), 2)
    for i in range(6):
        assert store.add(spark.range(i * 20, i * 20 + 30).select(F.concat(F.lit("SELECT "), "id").alias("response"))) == (30 if i == 0 else 20)
    assert store.scores.count() == 130 and store.version >= 1
    assert len(stored.committed(spark, str(tmp_path / "s"))) <= 2
    found = store.score(spark.range(5).select(F.concat(F.lit("SELECT "), "id").alias("response")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


# layouts


@pytest.mark.parametrize("hot_rows", [10**9, 50])
def test_stored_advantages_equal_unstored(spark, sf, tmp_path, hot_rows):
    """With and without a sample that owns a third of the rows."""
    many = spark.range(3000).select(F.lit(7).cast("long").alias("sample_id"), (F.col("id") + 10).cast("int").alias("candidate"), F.lit("model_1").alias("model"), F.concat(F.lit("SELECT c FROM t"), F.col("id") % 9).alias("response"))
    responses = generations(spark, sf).unionByName(many)
    keyed = stored.store_keyed(responses, str(tmp_path / "r"), "sample_id", 4, hot_rows)
    assert keyed.hot_keys == ([7] if hot_rows == 50 else [])
    schemas = reward.store_schemas(raw_samples(spark, sf), str(tmp_path / "c"), 4)
    got = jobs.stored_advantages(keyed, schemas, str(tmp_path / "w"), 4)
    want = jobs.advantages(responses, raw_samples(spark, sf))
    rounded = ["sample_id", "candidate", "model", F.round("reward", 9), F.round("advantage", 4)]
    assert rows_of(got, *rounded) == rows_of(want, *rounded)
    scored = reward.keyed_rewards(keyed, schemas).stored(str(tmp_path / "x"), 4)
    cold = reward.keyed_advantage(stored.Keyed(scored.cold, scored.hot, [], "sample_id"))
    assert "Exchange" not in final_plan(reward.keyed_rewards(keyed, schemas).cold)
    assert "Exchange" not in final_plan(cold)


def test_joins_of_keyed_tables(spark, tmp_path):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (9, "e")] + [(5, f"h{i}") for i in range(40)], "k long, v string")
    right = stored.store_bucketed(spark.createDataFrame([(1, 10), (1, 11), (5, 50), (3, 30)], "k long, w int"), str(tmp_path / "r"), "k", 4)
    keyed = stored.store_keyed(left, str(tmp_path / "l"), "k", 4, 20)
    assert keyed.hot_keys == [5]
    for how in ("inner", "left"):
        assert rows_of(stored.join_keyed(keyed, right, how).rows, "k", "v", "w") == rows_of(left.join(right, "k", how), "k", "v", "w")


def test_schemas_are_parsed_once_per_text(spark, sf):
    samples = raw_samples(spark, sf)
    dictionary = reward.schema_dictionary(samples)
    assert dictionary.count() == samples.select(F.coalesce("context", F.lit(""))).distinct().count() < 10
    lists = reward.schema_lists(samples)
    assert lists.count() == samples.count()
    from querymill.functions.ddl import known_tables

    want = samples.select("sample_id", F.coalesce(known_tables(F.col("context")), F.array()).alias("t"))
    assert rows_of(lists.select("sample_id", F.coalesce("__tables", F.array()).alias("t")), "sample_id", "t") == rows_of(want, "sample_id", "t")


# streams


def arriving(spark, sf, tmp_path, slices=6):
    ts = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, sample_id)")
    df = generations(spark, sf).withColumn("ts", ts)
    df.repartitionByRange(slices, F.desc("ts")).write.parquet(str(tmp_path / "in"))  # the latest come first
    return df, stream_corpus(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)


@pytest.mark.parametrize("compact_after", [100, 2])
def test_partials_keep_late_rows_without_state(spark, sf, tmp_path, compact_after):
    df, stream = arriving(spark, sf, tmp_path)
    path = str(tmp_path / "p")
    query = streaming.write_partials(streaming.score_stream(stream), path, str(tmp_path / "c"), "100 seconds", compact_after=compact_after)
    query.awaitTermination()
    assert not any(p.stateOperators for p in query.recentProgress)
    got = streaming.merged_intervals(spark, path)
    want = streaming.reward_monitor(reward.add_scores(df), "100 seconds")
    columns = ["interval_start", "model", "num_samples", "valid_sql_pct", F.round("avg_reward", 9), "syntax_correct_pct", "keyword_present_pct"]
    assert rows_of(got, *columns) == rows_of(want, *columns)


def test_merging_partials_changes_nothing_and_frees_files(spark, sf, tmp_path):
    df, stream = arriving(spark, sf, tmp_path)
    path = str(tmp_path / "p")
    scored = streaming.score_stream(stream)
    streaming.write_partials(scored, path, str(tmp_path / "c"), "100 seconds").awaitTermination()
    before = rows_of(streaming.merged_intervals(spark, path), "interval_start", "model", "num_samples")
    streaming.compact_partials(spark, path)
    assert rows_of(streaming.merged_intervals(spark, path), "interval_start", "model", "num_samples") == before
    assert len(stored.names(spark, f"{path}/batches")) == 6  # still there for reads under way
    df.where("sample_id < 100").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    streaming.write_partials(scored, path, str(tmp_path / "c"), "100 seconds").awaitTermination()
    streaming.compact_partials(spark, path)
    assert stored.names(spark, f"{path}/batches") == ["batch=6"]
    streaming.compact_partials(spark, path)  # nothing new
    total = streaming.merged_intervals(spark, path).agg(F.sum("num_samples")).first()[0]
    assert total == df.count() + df.where("sample_id < 100").count()
    # a merge without commit does not count
    spark.range(1).write.parquet(f"{path}/merged/upto=99")
    assert streaming.merged_intervals(spark, path).agg(F.sum("num_samples")).first()[0] == total


def test_stored_schemas_are_not_shuffled_in_a_stream(spark, sf, tmp_path):
    df, stream = arriving(spark, sf, tmp_path, 2)
    schemas = reward.store_schemas(raw_samples(spark, sf), str(tmp_path / "s"), 4)
    scored = streaming.score_stream(stream, schemas=schemas).select("sample_id", "candidate", "reward")
    query = streaming.write_available(scored, str(tmp_path / "out"), str(tmp_path / "c"))
    query.awaitTermination()
    plan = query._jsq.explainInternal(False).partition("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    want = reward.rewards(df, raw_samples(spark, sf))
    assert rows_of(spark.read.parquet(str(tmp_path / "out")), "sample_id", "candidate", "reward") == rows_of(want, "sample_id", "candidate", "reward")
