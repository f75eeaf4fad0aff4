"""Error analysis over a per-sample result table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.operators.columns import percent
from querymill.operators.sampling import first_n

SAMPLE_COLUMNS = (
    "question", "reference_sql", "predicted_sql", "valid", "token_accuracy",
    "structural_similarity", "reference_complexity",
)

_is_error = "exact_match = 0"


def error_set(results: DataFrame) -> DataFrame:
    return results.where(_is_error)


def error_rate(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs, errors, error rate and the share of errors that are not valid SQL, in one pass."""
    errors = F.count_if(F.expr(_is_error))
    invalid = F.count_if(F.expr(f"{_is_error} AND NOT valid"))
    return results.groupBy(*by).agg(
        F.count("exact_match").alias("total"),
        errors.alias("total_errors"),
        percent(errors, F.count("exact_match")).alias("error_rate"),
        invalid.alias("invalid_errors"),
        percent(invalid, errors).alias("invalid_pct"),
    )


def error_rate_by_level(results: DataFrame) -> DataFrame:
    """Error rate per reference complexity; levels without errors are left out."""
    rates = error_rate(results, ("reference_complexity",))
    return rates.where("total_errors > 0").select(
        "reference_complexity", "total_errors", "total", "error_rate"
    )


def error_samples(
    results: DataFrame, n: int = 20, order: tuple[str, ...] = ("sample_id",)
) -> DataFrame:
    """First n errors. Other metrics are left out before the cut, so they are not computed."""
    narrow = error_set(results).select(*dict.fromkeys((*SAMPLE_COLUMNS, *order)))
    return first_n(narrow, n, order).select(*SAMPLE_COLUMNS)
