"""Reports merged from states of batches."""

from pyspark.sql import functions as F

from checks.prep import processed
from querymill.operators import profile, report_states
from querymill.storage import store


def values(report):
    return {tuple(r)[:-1]: r["value"] for r in report.collect()}


def test_report_of_batches_equals_report_of_the_whole(spark, sf):
    samples = store(processed(spark, sf))
    parts = [report_states.report_state(samples.where(F.col("sample_id") % 5 == i)) for i in range(5)]
    merged = report_states.merge_states(parts[0].unionByName(parts[1]))
    for late in parts[2:]:  # one batch after the other
        merged = report_states.merge_states(merged.unionByName(late))
    got, want = values(report_states.report_of(merged)), values(profile.quality_report(samples))
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert abs(got[key] - value) <= 1e-6 * max(1, abs(value)), (key, got[key], value)
    assert report_states.report_of(report_states.report_state(samples.limit(0))).count() == 0


def test_sketches_hold_their_error(spark):
    """Many lengths and many tables, in three batches."""
    n = 60_000
    length = (F.xxhash64("id") % 100_000).cast("int")
    rows = spark.range(n).select(
        F.lit("train").alias("split"), F.lit("simple").alias("complexity"), F.abs(length).alias("sql_length"),
        F.concat(F.lit("CREATE TABLE t"), F.col("id") % 20_000, F.lit(" (a INT)")).alias("schema"), F.array(F.lit("SELECT")).alias("sql_keywords"), "id",
    )
    rows = store(rows)
    states = [report_states.report_state(rows.where(F.col("id") % 3 == i)) for i in range(3)]
    got = values(report_states.report_of(report_states.merge_states(states[0].unionByName(states[1]).unionByName(states[2]))))
    ordered = sorted(r[0] for r in rows.select("sql_length").collect())
    for p in profile.PERCENTILES:
        rank = sum(x <= got["train", "length", "sql_length", f"p{p}"] for x in ordered) / n
        assert abs(rank - p / 100) < 0.015
    assert abs(got["train", "schema", "tables", "distinct"] / 20_000 - 1) < 0.05
    assert got["train", "length", "sql_length", "max"] == ordered[-1]
    exact = rows.agg(F.avg("sql_length"), F.stddev_pop("sql_length")).first()
    assert abs(got["train", "length", "sql_length", "mean"] - exact[0]) < 1e-6
    assert abs(got["train", "length", "sql_length", "std"] / exact[1] - 1) < 1e-9
