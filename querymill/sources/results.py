"""Results at rest: per-sample CSV, summary JSON and the rendered report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.operators.evaluate import aggregate_all, report_rows
from querymill.schemas import RESULT
from querymill.sources.corpus import CSV
from querymill.sources.records import read_records

def write_results_csv(results: DataFrame, path: str) -> None:
    """Nulls get a marker of their own, so that an empty text stays one; texts may hold line breaks."""
    results.write.options(**CSV).mode("overwrite").csv(path)


def read_results_csv(spark: SparkSession, path: str, schema=RESULT) -> DataFrame:
    """Many tasks read a large file."""
    return read_records(spark, path, schema, **CSV)


def summary(results: DataFrame) -> DataFrame:
    """One JSON document: overall metrics, metrics per level, number of samples."""
    table = aggregate_all(results)
    metrics = [c for c in table.columns if c not in ("reference_complexity", "count")]
    overall = F.col("reference_complexity") == "all"
    level = F.struct(
        F.col("reference_complexity").alias("complexity"), "count", *metrics
    )
    row = table.agg(
        F.first(F.when(overall, F.struct(*metrics)), ignorenulls=True).alias("aggregate"),
        F.array_sort(F.collect_list(F.when(~overall, level))).alias("by_complexity"),
        F.coalesce(F.max(F.when(overall, F.col("count"))), F.lit(0)).alias("total_samples"),
    )
    return row.select(F.to_json(F.struct("*")).alias("value"))


def write_summary_json(results: DataFrame, path: str) -> None:
    summary(results).write.mode("overwrite").text(path)


def render_report(results: DataFrame) -> str:
    """``report_rows`` as lines of section, metric and value; a few dozen rows."""
    rows = report_rows(results).orderBy("section", "metric").collect()
    return "\n".join(f"{r['section']}\t{r['metric']}\t{r['value']:g}" for r in rows)
