"""Time the headline jobs and print one JSON line.

``BENCH_SF_DIR`` names the tables (default /root/testdata/sf0.1), ``BENCH_CPUS`` the cores.
A table of one file and one row group is read by one task, so every job is timed on the tables as
they are and, for ``many_files``, on copies of the same rows in ``FILES`` files, written before the
clock starts. The headline figures are those of the tables as they are.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import evaluation, prep, reward, sampling_profile
from checks.views import generations, raw_samples
from querymill.functions.extraction import add_extraction
from querymill.operators import evaluate
from querymill.operators import reward as R
from querymill.operators.prepare import evaluation_view
from querymill.operators.sampling import exact_splits
from querymill.plans import jobs


#: Files of a copied table.
FILES = 32


def evaluation_job(spark: SparkSession, sf: str) -> DataFrame:
    predictions = evaluate.predictions_from_responses(generations(spark, sf))
    results = evaluate.evaluate(predictions, evaluation_view(prep.kept(spark, sf)))
    return evaluate.aggregate_all(results)


# name -> (job, rows it works on as a multiple of the orders table)
JOBS = {
    "derive_responses": (generations, 4),
    "extract": (lambda s, d: add_extraction(generations(s, d)), 4),
    "rubric": (lambda s, d: R.add_scores(generations(s, d)), 4),
    "reward": (lambda s, d: R.rewards(generations(s, d), raw_samples(s, d)), 4),
    "advantage": (lambda s, d: jobs.advantages(generations(s, d), raw_samples(s, d)), 4),
    "prepare": (lambda s, d: jobs.corpus_summary(raw_samples(s, d)), 1),
    "exact_split": (lambda s, d: exact_splits(raw_samples(s, d)), 1),
    "profile": (sampling_profile.report, 1),
    "evaluate": (evaluation_job, 4),
    "compare_models": (evaluation.compare_models, 4),
    "batch_statistics": (reward.batch_statistics, 4),
}


def run(job, spark: SparkSession, sf: str) -> float:
    start = time.perf_counter()
    job(spark, sf).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def copied(spark: SparkSession, sf: str) -> str:
    """The folder of copies of all tables in many files; no rows are left out."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for path in sorted(Path(sf).glob("*.parquet")):
        spark.read.parquet(str(path)).repartition(FILES).write.parquet(f"{folder}/{path.name}")
    return folder


def timed(spark: SparkSession, sf: str, orders: int) -> tuple[dict[str, float], dict[str, int]]:
    """Seconds and rows per second of each job."""
    seconds = {name: run(job, spark, sf) for name, (job, _) in JOBS.items()}
    return seconds, {n: round(orders * JOBS[n][1] / t) for n, t in seconds.items() if t > 0}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm = Path(sf).parent / "sf0.001"
    if warm.exists():
        for job, _ in JOBS.values():
            run(job, spark, str(warm))
    orders = spark.read.parquet(f"{sf}/orders.parquet").agg(F.count("*")).first()[0]
    seconds, rates = timed(spark, sf, orders)
    spread_seconds, spread_rates = timed(spark, copied(spark, sf), orders)
    print(
        json.dumps(
            {
                "metric": "total time of the headline jobs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf).name,
                "rows_per_second": rates,
                "many_files": {"files": FILES, "value": round(sum(spread_seconds.values()), 3), "queries": spread_seconds, "rows_per_second": spread_rates},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
