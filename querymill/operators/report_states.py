"""The quality report from states that add up: each batch is read once, later ones are merged in.

A state is a table of one row per group, kind and item: counts, sums and extremes, which are exact, and
sketches where a result needs more than that, KLL for percentiles of lengths and theta for distinct
tables. States of batches are united and grouped again; the order does not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.functions.cleaning import LEVELS
from querymill.functions.ddl import rough_column_count, rough_tables
from querymill.operators.columns import percent
from querymill.operators.prepare import quality_conditions
from querymill.operators.profile import LENGTHS, PERCENTILES

#: Size parameters of the sketches: ranks within about 0.7 % (KLL), counts within about 1.6 % (theta).
KLL, THETA = 400, 14


def _entry(kind: str, item: Column, value: Column | None = None, name: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        item.cast("string").alias("item"),
        (F.lit(None) if value is None else value).cast("long").alias("value"),
        (F.lit(None) if name is None else name).cast("string").alias("name"),
    )


def report_state(df: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """State of a table of processed samples, in one pass with map-side combine.

    Each sample gives a small entry per count that it takes part in.
    """
    tables = rough_tables(F.col("schema"))
    entries = [F.array(_entry("all", F.lit("")), _entry("complexity", F.col("complexity")))]
    lengths = [(c, F.col(c)) for c in LENGTHS if c in df.columns] + [("tables", F.size(tables)), ("columns", rough_column_count(F.col("schema")))]
    entries.append(F.array(*[_entry("length", F.lit(c), v) for c, v in lengths]))
    marks = [F.when(F.coalesce(c, F.lit(False)), _entry("quality", F.lit(n))) for n, c in quality_conditions(df).items()]
    entries.append(F.array_compact(F.array(*marks)))
    entries.append(F.transform(F.coalesce("sql_keywords", F.array().cast("array<string>")), lambda k: _entry("keyword", k)))
    entries.append(F.transform(tables, lambda t: _entry("tables", F.lit(""), name=t)))
    rows = df.select(*by, F.inline(F.concat(*entries)))
    value = F.col("value")
    return rows.groupBy(*by, "kind", "item").agg(
        F.count("*").alias("n"),
        F.sum(value).alias("total"),
        F.sum(value.cast("decimal(20,0)") * value).cast("decimal(38,0)").alias("squares"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
        F.kll_sketch_agg_bigint(value, KLL).alias("ranks"),
        F.theta_sketch_agg("name", THETA).alias("names"),
    )


def merge_states(states: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """One state of the states of several batches."""
    return states.groupBy(*by, "kind", "item").agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.sum("squares").cast("decimal(38,0)").alias("squares"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.kll_merge_agg_bigint("ranks", KLL).alias("ranks"),
        F.theta_union_agg("names", THETA).alias("names"),
    )


def report_of(state: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """``quality_report`` of a merged state: the same rows and metrics.

    Counts, shares, means, deviations and extremes are exact; medians and percentiles are values of
    the samples at ranks within the sketch's error, and distinct tables are estimated.
    """
    totals = state.where("kind = 'all'").select(*by, F.col("n").alias("__all"))
    rows = state.where("kind <> 'all'").join(totals, list(by))
    kind, item, n = F.col("kind"), F.col("item"), F.col("n")
    pct = percent(n, F.col("__all"))

    def metric(section: Column | str, name: str, value: Column) -> Column:
        return F.struct((F.lit(section) if isinstance(section, str) else section).alias("section"), item.alias("item"), F.lit(name).alias("metric"), value.cast("double").alias("value"))

    counted = F.array(metric(kind, "samples", n), metric(kind, "pct", pct))
    mean = F.col("total") / n
    spread = F.sqrt(F.greatest(F.col("squares").cast("double") / n - mean * mean, F.lit(0.0)))
    section = F.when(item.isin(*LENGTHS), "length").otherwise("schema")
    points = F.kll_sketch_get_quantile_bigint("ranks", F.array(*[F.lit(p / 100) for p in (50, *PERCENTILES)]))
    stats = [metric(section, "mean", mean), metric(section, "median", F.get(points, F.lit(0))), metric(section, "min", F.col("least")), metric(section, "max", F.col("most"))]
    tall = [F.when(item.isin("question_length", "sql_length"), metric(section, f"p{p}", F.get(points, F.lit(i + 1)))) for i, p in enumerate(PERCENTILES)]
    deviation = F.when(item.isin(*LENGTHS), metric(section, "std", spread))
    quality = F.array(metric("quality", "samples", n))
    tables = F.array(F.struct(F.lit("schema").alias("section"), F.lit("tables").alias("item"), F.lit("distinct").alias("metric"), F.theta_sketch_estimate("names").cast("double").alias("value")))
    listed = (
        F.when(kind == "length", F.array_compact(F.array(*stats, deviation, *tall)))
        .when(kind == "quality", quality)
        .when(kind == "tables", tables)
        .when((kind != "complexity") | item.isin(*LEVELS), counted)
    )
    return rows.where(listed.isNotNull()).select(*by, F.inline(listed))
