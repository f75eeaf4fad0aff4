"""CSV records with line breaks, read by many tasks."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from querymill.schemas import RAW
from querymill.sources import corpus, records


def write_csv(path, rows, end="\n"):
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(["sample_id", "question", "context", "answer"])
        for r in rows:
            w.writerow(["\\N" if x is None else x for x in r])


def some_rows(n, seed=1):
    random.seed(seed)
    parts = ["a", '"', "\n", ",", "é", " ", "\r", '""', "\n\n", "SELECT 1", "x" * 40]
    text = lambda: random.choice(["k", "t"]) + "".join(random.choices(parts, k=random.randint(0, 9)))
    return [(i, text(), None if i % 7 == 0 else text(), text()) for i in range(n)]


@pytest.fixture()
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    spark.conf.set("spark.sql.files.minPartitionNum", "40")
    yield
    for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{k}")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_blocks_of_one_file_equal_python(spark, tmp_path, small_blocks, end):
    rows = some_rows(300)
    write_csv(tmp_path / "a.csv", rows, end)
    write_csv(tmp_path / "b.csv", some_rows(50, 2), end)
    write_csv(tmp_path / "empty.csv", [], end)
    got = corpus.read_corpus(spark, str(tmp_path), fmt="csv")
    assert got.schema == RAW
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows + some_rows(50, 2), key=str)
    blocks = records._lines(spark, str(tmp_path / "a.csv")).select("__block").distinct().count()
    assert blocks > 20


def test_one_record_over_many_blocks(spark, tmp_path, small_blocks):
    rows = [(1, "q", "c", "\n".join(["line"] * 2000)), (2, "w" * 5000, None, ""), (3, "\n" * 3000, "c", 'end"')]
    write_csv(tmp_path / "a.csv", rows)
    got = corpus.read_corpus(spark, str(tmp_path), fmt="csv").orderBy("sample_id").collect()
    want = [(1, "q", "c", rows[0][3]), (2, rows[1][1], None, None), (3, rows[2][1], "c", 'end"')]
    assert [tuple(r) for r in got] == want


def test_equals_the_reader_of_one_task(spark, tmp_path):
    rows = spark.createDataFrame([r for r in some_rows(200, 3)] + [(900, "", None, " x ")], RAW)
    rows.repartition(3).write.options(**corpus.CSV).csv(str(tmp_path / "c"))
    many = corpus.read_corpus(spark, str(tmp_path / "c"), fmt="csv")
    one = corpus.read_corpus(spark, str(tmp_path / "c"), fmt="csv", multiLine=True)
    assert sorted(map(tuple, many.collect()), key=str) == sorted(map(tuple, one.collect()), key=str)
    assert many.where(F.col("question") == "").count() == 1


def test_only_longer_records_are_brought_together(spark, tmp_path):
    write_csv(tmp_path / "a.csv", [(i, "q", "c", "one\ntwo" if i % 100 == 0 else "s") for i in range(2000)])
    df = records.record_texts(spark, str(tmp_path / "a.csv"))
    assert df.where(F.contains("__record", F.lit("\n"))).count() == 20 and df.count() == 2001


def test_lines_that_are_records_are_not_shuffled(spark, tmp_path, small_blocks):
    """Only blocks that begin or end inside a quoted text, or hold a break of one, are windowed."""
    plain = [(i, "q", 'say "x"', "\r" if i == 7 else "s" * (i % 50)) for i in range(400)]
    write_csv(tmp_path / "plain.csv", plain)
    df = records.record_texts(spark, str(tmp_path / "plain.csv"))
    assert df.count() == 401 and df.where("__first").count() == 1
    assert not any("/lines-" in f for f in df.inputFiles())
    broken = [(1000 + i, "q\n" if i == 200 else "q", None, "s" * 40) for i in range(400)]
    write_csv(tmp_path / "some.csv", broken)
    df = records.record_texts(spark, str(tmp_path))
    assert any("/lines-" in f for f in df.inputFiles())
    singles = spark.read.parquet(*[f for f in df.inputFiles() if "/records-" in f]).count()
    assert 401 < singles < 802
    got = corpus.read_corpus(spark, str(tmp_path), fmt="csv").collect()
    want = [(a, b, c, d or None) for a, b, c, d in plain + broken]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
