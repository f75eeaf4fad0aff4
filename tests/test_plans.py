"""What the physical plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from checks import registry
from checks.views import generations, raw_samples
from querymill.operators import prepare, reward, sampling
from querymill.storage import shared_folder, store
import __spark_entry__  # noqa: F401

# Work at call time (files, streams, several jobs); their plans are plain scans.
EAGER = re.compile(r"^(scan|sink|stream|split_exact|split_strat|sample_.*large|sample_evaluation)")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if not EAGER.match(n)))
def test_no_python_and_no_single_task_window(spark, sf, name):
    plan = plan_of(registry.QUERIES[name](spark, sf))
    assert "Python" not in plan and "ArrowEval" not in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"\bWindow \[", line):
            assert not any("SinglePartition" in below for below in lines[i : i + 4]), name
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_cleaning_is_not_repeated_by_a_filter(spark, sf):
    plan = plan_of(prepare.filter_samples(prepare.preprocess(raw_samples(spark, sf))))
    assert plan.count("array_join(transform(regexp_extract_all(") == 1


def test_scores_are_not_repeated_by_a_filter(spark, sf):
    scored = reward.add_scores(generations(spark, sf)).where("total > 0.5 AND extracted_sql IS NOT NULL")
    assert plan_of(scored).count("filter(transform(regexp_extract_all(") == 1


def test_unused_columns_are_not_read(spark, tmp_path, sf):
    raw_samples(spark, sf).write.parquet(str(tmp_path / "raw"))
    df = spark.read.parquet(str(tmp_path / "raw"))
    plan = plan_of(reward.schema_lists(df))
    assert "ReadSchema: struct<sample_id:bigint,context:string>" in plan


def test_ranked_samples_limit_before_the_shuffle(spark, sf):
    df = spark.range(10).select(F.col("id").alias("sample_id"), F.lit("simple").alias("complexity"))
    assert "WindowGroupLimit" in plan_of(sampling.examples_per_level(df, 2))


def test_stored_tables_use_the_named_folder(spark):
    folder = shared_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir")
    kept = store(spark.range(5), "numbers")
    assert kept.count() == 5 and folder in kept.inputFiles()[0]


def test_every_oracle_belongs_to_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert not [n for n in registry.QUERIES if re.match(r"op\d|.*pipeline", n)]


def test_a_hot_key_is_split_in_the_joins(spark):
    """A third of all responses belong to one sample; AQE must split that join partition."""
    hot = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
    responses = spark.range(0, 60000, 1, 4).select(
        hot.alias("sample_id"), F.lit("m").alias("model"), F.col("id").cast("int").alias("candidate"),
        F.concat(F.lit("SELECT a FROM t WHERE x = "), F.col("id")).alias("response"),
        (F.col("id") % 7 / 7.0).alias("reward"),
    )
    samples = spark.range(60000).select(
        F.col("id").alias("sample_id"), F.lit("CREATE TABLE t (a INT)").alias("context")
    )
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        jobs_ = {
            "rewards": reward.rewards(responses.drop("reward"), samples),
            "advantage": reward.relative_advantage(store(responses.drop("response"), "rewards")),
        }
        for name, df in jobs_.items():
            assert len(df.collect()) == 60000
            assert "skew=true" in plan_of(df) or "SortMergeJoin(skew=true)" in plan_of(df), name
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
