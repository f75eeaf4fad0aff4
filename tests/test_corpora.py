"""Preparation, splits, samples and profiles over tables."""

import pytest
from pyspark.sql import functions as F

from checks.views import raw_samples
from querymill.operators import prepare, profile, sampling
from querymill.plans import jobs
from querymill.sources import corpus


def numbers(spark, n, hot=0):
    """n ids with a level; ``hot`` more rows of the level "simple"."""
    level = F.when(F.col("id") % 10 < 5, "simple").when(F.col("id") % 10 < 8, "medium").otherwise("complex")
    df = spark.range(n).select(F.col("id").alias("sample_id"), level.alias("complexity"))
    more = spark.range(n, n + hot).select(F.col("id").alias("sample_id"), F.lit("simple").alias("complexity"))
    return df.union(more)


def test_prepare_whole_corpus(spark, sf, tmp_path):
    raw = raw_samples(spark, sf)
    path = str(tmp_path / "processed")
    done = jobs.prepare_corpus(raw, path)
    assert done.count() == 1250
    split = corpus.read_processed(spark, path, "test")
    assert split.count() == done.where("split = 'test'").count() > 0
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    unfiltered = jobs.prepare_corpus(raw, opts=prepare.PrepareOptions(filter_invalid=False))
    assert unfiltered.count() == raw.count()


def test_absent_columns_become_null(spark, tmp_path):
    spark.createDataFrame([(1, "q")], "sample_id long, question string").write.parquet(str(tmp_path / "p"))
    df = corpus.read_corpus(spark, str(tmp_path / "p"))
    assert df.first() == (1, "q", None, None)
    row = prepare.preprocess(df).first()
    assert not row["is_valid"] and row["validation_error"] == "Empty answer (SQL)"
    bare = spark.createDataFrame([(1, "q")], "sample_id long, question string")
    assert prepare.validate(bare).first()["validation_error"] == "Missing required field: context"


def test_csv_corpus(spark, tmp_path):
    rows = [(1, 'say "hi"', "a\nb", "SELECT 1, 2")]
    df = spark.createDataFrame(rows, "sample_id long, question string, context string, answer string")
    df.write.options(header=True, escape='"').csv(str(tmp_path / "csv"))
    assert corpus.read_corpus(spark, str(tmp_path / "csv"), fmt="csv", multiLine=True).collect() == df.collect()


def test_csv_corpus_whole_by_default(spark, tmp_path):
    rows = [(1, "a\nb", None, "SELECT 1"), (2, "", "", ""), (3, " x ", "c\r\nd\re", 'say "hi", \\'), (4, None, "\n", None)]
    df = spark.createDataFrame(rows, "sample_id long, question string, context string, answer string")
    df.write.options(**corpus.CSV).csv(str(tmp_path / "csv"))
    back = corpus.read_corpus(spark, str(tmp_path / "csv"), fmt="csv").orderBy("sample_id").collect()
    assert [tuple(r) for r in back] == rows
    plain = spark.createDataFrame([(1, "a\nb", "c", "d")], df.schema)
    plain.write.options(header=True, escape='"').csv(str(tmp_path / "plain"))
    assert corpus.read_corpus(spark, str(tmp_path / "plain"), fmt="csv").collect() == plain.collect()
    one = df.where("sample_id = 2")
    one.write.options(**corpus.CSV).csv(str(tmp_path / "lines"))
    assert corpus.read_corpus(spark, str(tmp_path / "lines"), fmt="csv", multiLine=False).collect() == one.collect()


def test_filter_accounting_of_nothing(spark, sf):
    empty = prepare.preprocess(raw_samples(spark, sf).limit(0))
    assert tuple(prepare.filter_accounting(empty).first()) == (0, 0, 0.0, 0)


def test_hash_split_is_stable(spark):
    df = numbers(spark, 20000)
    one = {tuple(r) for r in sampling.assign_splits(df).select("sample_id", "split").collect()}
    two = {tuple(r) for r in sampling.assign_splits(df.repartition(13)).select("sample_id", "split").collect()}
    assert one == two and len(one) == 20000
    shares = sampling.assign_splits(df).groupBy("split").count().collect()
    assert {r["split"]: round(r["count"] / 20000, 1) for r in shares} == {"train": 0.8, "validation": 0.1, "test": 0.1}
    two_way = sampling.assign_splits(df, 0.5, 0.5, 0.0)
    assert {r["split"] for r in two_way.select("split").distinct().collect()} == {"train", "validation"}
    with pytest.raises(ValueError):
        sampling.assign_splits(df, 0.8, 0.1, 0.2)


@pytest.mark.parametrize("n", [0, 1, 7, 1003])
def test_exact_sizes(spark, n):
    df = numbers(spark, n)
    got = {r["split"]: r["count"] for r in sampling.exact_splits(df).groupBy("split").count().collect()}
    rest = -(-n * 2 // 10)
    test = -(-rest // 2)
    want = {"train": n - rest, "validation": rest - test, "test": test}
    assert got == {k: v for k, v in want.items() if v}


def test_stratified_split_with_a_hot_stratum(spark):
    df = numbers(spark, 3000, hot=5000)
    out = sampling.exact_splits(df, stratify_by="complexity")
    assert out.count() == 8000 and out.select("sample_id").distinct().count() == 8000
    for r in out.groupBy("complexity").pivot("split").count().collect():
        n = r["train"] + r["validation"] + r["test"]
        assert r["validation"] + r["test"] == -(-n * 2 // 10)
    again = sampling.exact_splits(df.repartition(11), stratify_by="complexity")
    assert out.exceptAll(again.select(*out.columns)).isEmpty()


def test_many_strata_take_the_join(spark):
    df = spark.range(3000).select(F.col("id").alias("sample_id"), (F.col("id") % 1500).alias("g"))
    out = sampling.exact_splits(df, 0.5, 0.5, 0.0, stratify_by="g")
    counts = out.groupBy("g").pivot("split").count()
    assert counts.where("train = 1 AND validation = 1").count() == 1500


def test_uniform_sample_is_exact(spark):
    df = numbers(spark, 5000)
    few = {r[0] for r in sampling.uniform_sample(df, 700).select("sample_id").collect()}
    more = {r[0] for r in sampling.uniform_sample(df, 1400).select("sample_id").collect()}
    assert len(few) == 700 and len(more) == 1400 and few < more
    assert sampling.uniform_sample(df, 6000).count() == 5000
    assert sampling.step_sample(df, 5, 1).collect() != sampling.step_sample(df, 5, 2).collect()
    repeated = df.select((F.col("sample_id") % 50).alias("sample_id"), F.col("sample_id").alias("candidate"))
    assert sampling.uniform_sample(repeated, 1001).count() == 1001


def test_first_rows(spark):
    df = numbers(spark, 50000).repartition(9)
    assert [r[0] for r in sampling.first_n(df, 1234).select("sample_id").collect()] == list(range(1234))
    assert sampling.first_n(df, 60000).count() == 50000
    assert sampling.first_n(df.limit(0), 50).count() == 0


def test_allocation():
    assert sampling.allocation({"simple": 50, "medium": 30, "complex": 20}, 10) == {"simple": 5, "medium": 3, "complex": 2}
    assert sampling.allocation({"simple": 998, "medium": 1, "complex": 1}, 10) == {"simple": 9, "medium": 1, "complex": 1}
    assert sampling.allocation({"simple": 1, "medium": 1, "complex": 1}, 10) == {"simple": 4, "medium": 3, "complex": 3}
    assert sampling.allocation({}, 10) == {}


def test_evaluation_set(spark):
    drawn = sampling.evaluation_set(numbers(spark, 100), 20)
    got = {r["complexity"]: r["count"] for r in drawn.groupBy("complexity").count().collect()}
    assert got == {"simple": 10, "medium": 6, "complex": 4}
    assert sampling.evaluation_set(numbers(spark, 100).drop("complexity"), 20).count() == 20


def test_first_rows_of_a_hot_group(spark):
    df = spark.range(30000).select(
        F.col("id"), F.when(F.col("id") % 3 < 2, "hot").otherwise(F.col("id").cast("string")).alias("g")
    )
    out = sampling.top_n_per_group(df, ["g"], ["id"], 3)
    assert [r["id"] for r in out.where("g = 'hot'").orderBy("id").collect()] == [0, 1, 3]
    assert out.count() == 10003


def test_split_policy_and_fallback(spark):
    df = numbers(spark, 50)
    assert sampling.ensure_splits(df.withColumn("split", F.lit("x"))).select("split").distinct().first()[0] == "x"
    assert sampling.ensure_splits(df, create=False).select("split").distinct().first()[0] == "train"
    named = df.withColumn("split", F.when(F.col("sample_id") < 5, "validation").otherwise("train"))
    assert corpus.split_or_validation(named, "test").count() == 5
    assert corpus.split_or_validation(named, "train").count() == 45
    assert corpus.split_or_validation(named).count() == 5


def test_profiles(spark):
    df = spark.createDataFrame(
        [(1, "a b", "SELECT MIN(x) FROM t", None), (2, "", "", "CREATE TABLE a (x INT)"), (3, "a", "SELECT 1", "create table A (x INT)")],
        "sample_id long, question string, answer string, context string",
    )
    row = profile.corpus_statistics(df).first()
    assert (row["avg_question_length"], row["median_sql_length"], row["max_schema_length"]) == (1.0, 2.0, 5)
    assert profile.distinct_table_count(df).first()[0] == 2
    assert [tuple(r) for r in profile.keyword_histogram(df, k=2).collect()] == [("SELECT", 2), ("FROM", 1)]
    nothing = profile.corpus_statistics(df.limit(0)).first()
    assert nothing["total_samples"] == 0 and nothing["avg_question_length"] == 0.0
    levels = profile.complexity_distribution(prepare.preprocess(df))
    assert {r["complexity"]: r["samples"] for r in levels.collect()} == {"simple": 3, "medium": 0, "complex": 0}


def test_approximate_options(spark, sf):
    raw = raw_samples(spark, sf)
    exact, rough = profile.corpus_statistics(raw).first(), profile.corpus_statistics(raw, accuracy=10000).first()
    assert abs(exact["median_sql_length"] - rough["median_sql_length"]) <= 1
    assert profile.distinct_table_count(raw, rsd=0.05).first()[0] == 3


def test_minimum_lengths(spark, sf):
    df = prepare.preprocess(raw_samples(spark, sf))
    kept = prepare.keep_above_minimum(df, 8, 30)
    assert kept.where(F.length("question") < 8).isEmpty() and kept.where(F.length("sql") < 30).isEmpty()


def _counted(spark, rows, schema, slices=9):
    """A frame that counts how often its rows are made."""
    made = spark.sparkContext.accumulator(0)

    def touch(row):
        made.add(1)
        return row

    return spark.createDataFrame(spark.sparkContext.parallelize(rows, slices).map(touch), schema), made


@pytest.mark.parametrize("n", [0, 1, 7, 100, 1500, 4000, 6000])
def test_first_n_reads_once_for_any_order(spark, monkeypatch, n):
    monkeypatch.setattr(sampling, "MARKS", 64)
    rows = [(i, None if i % 11 == 0 else f"t{i * 37 % 400:03d}", i * 91 % 5000) for i in range(5000)]
    df, made = _counted(spark, rows, "sample_id long, name string, v long")
    got = sampling.first_n(df, n, ("name", "v")).collect()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[2]))[:n]
    assert [tuple(r) for r in got] == want
    assert made.value == len(rows)


def test_first_n_with_one_key_everywhere(spark, monkeypatch):
    monkeypatch.setattr(sampling, "MARKS", 16)
    df = spark.range(3000).select(F.lit("same").alias("k"), "id")
    for n in (10, 700, 2999):
        got = [r[1] for r in sampling.first_n(df, n, ("k",)).collect()]
        assert len(got) == len(set(got)) == n


def test_first_n_shuffles_no_more_than_the_cut(spark, monkeypatch):
    """Neither the table nor the runs are exchanged by range; what is sorted is little more than n."""
    plans, sizes = [], []

    def watched(df, name, keep=sampling.store):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        out = keep(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(sampling, "store", watched)
    df = spark.range(0, 200_000, 1, 16).select((F.xxhash64("id") % 1_000_000).alias("sample_id"))
    assert sampling.first_n(df, 5000).count() == 5000
    assert "Exchange" not in dict(plans)["first-runs"]
    assert dict(sizes)["sorted"] <= 5000 + 16 * 5 + 16


def test_many_strata_are_cut_without_repeating_rows(spark):
    """200,000 strata, one of them with a third of the rows; sizes are exact in each."""
    small = spark.range(800_000).select(F.col("id").alias("sample_id"), F.concat(F.lit("s"), F.col("id") % 200_000).alias("kind"))
    big = spark.range(800_000, 1_200_000).select(F.col("id").alias("sample_id"), F.lit("s3").alias("kind"))
    got = sampling.exact_splits(small.union(big), 0.5, 0.25, 0.25, stratify_by="kind")
    counts = got.groupBy("kind").pivot("split", ["train", "validation", "test"]).count().na.fill(0)
    rows = counts.groupBy("train", "validation", "test").count().collect()
    assert sorted(map(tuple, rows)) == [(2, 1, 1, 199_999), (200_002, 100_001, 100_001, 1)]


def test_cut_keys_read_no_row_twice_over(spark):
    keyed = spark.range(5000).select((F.col("id") % 3).cast("string").alias("k"), sampling.sample_key(1, "id").alias("__key"))
    wanted = {"a": F.lit(10), "b": F.col("__total") - 5, "c": F.lit(0), "d": F.col("__total")}
    cuts = {(r["k"], r["__cut"]): r["__cut_key"] for r in sampling._cut_keys(keyed, "k", wanted).collect()}
    rows = {}
    for r in keyed.collect():
        rows.setdefault(r["k"], []).append(r["__key"])
    want = {}
    for k, keys in rows.items():
        keys.sort()
        want |= {(k, "a"): keys[9], (k, "b"): keys[-6], (k, "d"): keys[-1]}
    assert cuts == want
    plan = sampling._met(keyed, "k", 4, lambda h: h.withColumn("__ranks", F.array(F.struct(F.lit("a").alias("__cut"), F.lit(1).alias("__rank")))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1  # of the few ranks met, above the histogram
