"""Corpus statistics and quality profiles.

Percentiles are exact. Their state is a histogram of distinct values, and word counts take few;
``accuracy`` switches to a bounded sketch for columns with many values. Fixed keyword lists are
counted with conditional counts in one pass instead of exploding every sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.functions.cleaning import LEVELS
from querymill.functions.ddl import rough_column_count, rough_tables
from querymill.functions.text import or_empty, word_count
from querymill.operators.columns import as_rows, percent, text_field
from querymill.operators.prepare import quality_conditions

# Keywords counted in the corpus statistics.
TRACKED_KEYWORDS = (
    "SELECT", "FROM", "WHERE", "JOIN", "INNER JOIN", "LEFT JOIN", "RIGHT JOIN", "GROUP BY",
    "ORDER BY", "HAVING", "LIMIT", "UNION", "DISTINCT", "COUNT", "SUM", "AVG", "MAX", "MIN",
)
# Reported percentiles.
PERCENTILES = (25, 50, 75, 90, 95, 99)


def _percentile(col: Column, share: float, accuracy: int | None) -> Column:
    if accuracy:
        return F.percentile_approx(col, share, accuracy).cast("double")
    return F.percentile(col, share)


def corpus_statistics(
    df: DataFrame, by: Sequence[str] = (), accuracy: int | None = None
) -> DataFrame:
    """Sample count and average / median / greatest word count of the three raw texts."""
    lengths = df.select(
        *by,
        word_count(text_field(df, "question")).alias("question"),
        word_count(text_field(df, "answer")).alias("sql"),
        word_count(text_field(df, "context")).alias("schema"),
    )
    stats = [F.count("*").alias("total_samples")]
    for name in ("question", "sql", "schema"):
        stats += [
            F.coalesce(F.avg(name), F.lit(0.0)).alias(f"avg_{name}_length"),
            F.coalesce(_percentile(F.col(name), 0.5, accuracy), F.lit(0.0)).alias(
                f"median_{name}_length"
            ),
            F.coalesce(F.max(name), F.lit(0)).alias(f"max_{name}_length"),
        ]
    return lengths.groupBy(*by).agg(*stats)


def distinct_table_count(
    df: DataFrame, schema: str = "context", by: Sequence[str] = (), rsd: float | None = None
) -> DataFrame:
    """Distinct table names over all schemas; ``rsd`` switches to an approximate count."""
    names = df.select(*by, F.explode(rough_tables(F.col(schema))).alias("__name"))
    count = F.approx_count_distinct("__name", rsd) if rsd else F.count_distinct("__name")
    return names.groupBy(*by).agg(count.alias("unique_tables_count"))


def keyword_histogram(df: DataFrame, sql: str = "answer", k: int = 10) -> DataFrame:
    """The k most frequent tracked keywords (substring test), ties in keyword order."""
    up = df.select(F.upper(or_empty(F.col(sql))).alias("__up"))
    counts = up.agg(
        *[F.count_if(F.contains("__up", F.lit(w))).alias(w) for w in TRACKED_KEYWORDS]
    )
    rows = as_rows(
        counts, (), [((w,), F.col(f"`{w}`")) for w in TRACKED_KEYWORDS], ("keyword", "samples")
    )
    return top_k(rows.where("samples > 0"), "samples", "keyword", k)


def top_k(df: DataFrame, count: str, key: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(count), F.asc(key)).limit(k)


def complexity_distribution(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count and share of the three levels; a level without samples shows 0."""
    counts = df.groupBy(*by).agg(
        F.count("*").alias("__all"),
        *[F.count_if(F.col("complexity") == level).alias(level) for level in LEVELS],
    )
    rows = as_rows(
        counts, (*by, "__all"), [((v,), F.col(v)) for v in LEVELS], ("complexity", "samples")
    )
    pct = percent(F.col("samples"), F.col("__all")).alias("pct")
    return rows.select(*by, "complexity", "samples", pct)


def observed_distribution(df: DataFrame, column: str = "complexity") -> DataFrame:
    """Count per value that occurs, sorted by value."""
    return df.groupBy(column).agg(F.count("*").alias("samples")).orderBy(column)


def keyword_frequency(df: DataFrame, k: int | None = 15, by: Sequence[str] = ()) -> DataFrame:
    """Samples per listed keyword with their share. ``k=None`` lists all of them."""
    counts = (
        df.select(*by, F.explode("sql_keywords").alias("keyword"))
        .groupBy(*by, "keyword")
        .agg(F.count("*").alias("samples"))
    )
    totals = df.groupBy(*by).agg(F.count("*").alias("__all"))
    if by:
        counts, total = counts.join(totals, list(by)), F.col("__all")
    else:
        total = totals.scalar()
    pct = percent(F.col("samples"), total).alias("pct")
    rows = counts.select(*by, "keyword", "samples", pct)
    if k is None:
        return rows
    if not by:
        return top_k(rows, "samples", "keyword", k)
    rank = Window.partitionBy(*by).orderBy(F.desc("samples"), F.asc("keyword"))
    return rows.withColumn("__rank", F.row_number().over(rank)).where(F.col("__rank") <= k).drop("__rank")


LENGTHS = ("question_length", "sql_length", "schema_length")


def _at(values: str, i: int) -> Column:
    return F.get(F.col(values), F.lit(i)).cast("double")


def length_profile(
    df: DataFrame, by: Sequence[str] = (), accuracy: int | None = None
) -> DataFrame:
    """One row per length column: mean, median, extremes, population deviation, percentiles.

    All percentiles of a column come from one histogram.
    """
    present = [c for c in LENGTHS if c in df.columns]
    points = F.array(*[F.lit(p / 100) for p in (50, *PERCENTILES)])
    aggs: list[Column] = []
    for c in present:
        at = F.percentile(c, points) if accuracy is None else F.percentile_approx(c, points, accuracy)
        aggs += [at.alias(f"__{c}_at"), *[f(c).alias(f"__{c}_{f.__name__}") for f in (F.avg, F.min, F.max, F.stddev_pop)]]
    row = df.groupBy(*by).agg(*aggs)
    fields = []
    for c in present:
        shown = [F.when(F.lit(c != "schema_length"), _at(f"__{c}_at", i + 1)).alias(f"p{p}") for i, p in enumerate(PERCENTILES)]
        stats = [F.col(f"__{c}_{f}").alias(n) for f, n in (("min", "min"), ("max", "max"), ("stddev_pop", "std"))]
        fields.append(F.struct(F.lit(c).alias("field"), F.col(f"__{c}_avg").alias("mean"), _at(f"__{c}_at", 0).alias("median"), *stats, *shown))
    return row.select(*by, F.inline(F.array(*fields)))


def schema_profile(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rough tables and columns per sample: mean, median, least, greatest."""
    counts = df.select(
        *by,
        F.size(rough_tables(F.col("schema"))).alias("tables"),
        rough_column_count(F.col("schema")).alias("columns"),
    )
    stats = [
        F.struct(
            F.lit(c).alias("field"),
            F.avg(c).alias("mean"),
            F.percentile(c, 0.5).alias("median"),
            F.min(c).alias("min"),
            F.max(c).alias("max"),
        ).alias(c)
        for c in ("tables", "columns")
    ]
    row = counts.groupBy(*by).agg(*stats)
    return row.select(*by, F.inline(F.array(F.col("tables"), F.col("columns"))))


def split_summary(df: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Samples, valid share and average lengths per split."""
    valid = F.count_if("is_valid")
    return df.groupBy(*by).agg(
        F.count("*").alias("samples"),
        valid.alias("valid_samples"),
        percent(valid, F.count("*")).alias("valid_pct"),
        *[F.avg(c).alias(f"avg_{c}") for c in LENGTHS],
    )


def token_length_profile(
    df: DataFrame,
    max_length: int = 2048,
    prompt: str = "prompt",
    count_tokens=word_count,
    by: Sequence[str] = (),
) -> DataFrame:
    """Prompt lengths against a limit. ``count_tokens`` maps a column to a count; it may be a
    user's Arrow function around a tokenizer."""
    lengths = df.select(*by, count_tokens(F.col(prompt)).alias("__n"))
    too_long = F.count_if(F.col("__n") > max_length)
    return lengths.groupBy(*by).agg(
        F.count("*").alias("num_samples_checked"),
        F.avg("__n").alias("avg_token_length"),
        F.percentile("__n", 0.5).alias("median_token_length"),
        F.max("__n").alias("max_token_length"),
        F.min("__n").alias("min_token_length"),
        too_long.alias("too_long_count"),
        percent(too_long, F.count("*")).alias("too_long_pct"),
        F.lit(max_length).alias("max_length_threshold"),
    )


def quality_report(df: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Everything above as ``split, section, item, metric, value`` rows.

    The scalar sections share one aggregation. Pass a stored table: keywords and distinct tables
    are two further passes over it.
    """
    lengths = [c for c in LENGTHS if c in df.columns]
    checks = quality_conditions(df)
    base = df.select(
        "*",
        F.size(rough_tables(F.col("schema"))).alias("__tables"),
        rough_column_count(F.col("schema")).alias("__columns"),
    )
    aggs: list[Column] = [F.count("*").alias("__all")]
    entries: list[tuple[tuple[str, str, str], Column]] = []

    def add(section: str, item: str, metric: str, value: Column) -> None:
        name = f"__v{len(aggs)}"
        aggs.append(value.alias(name))
        entries.append(((section, item, metric), F.col(name).cast("double")))

    for level in LEVELS:
        hit = F.count_if(F.col("complexity") == level)
        add("complexity", level, "samples", hit)
        add("complexity", level, "pct", percent(hit, F.count("*")))
    profiles = [("length", c, c) for c in lengths]
    profiles += [("schema", "tables", "__tables"), ("schema", "columns", "__columns")]
    for section, item, c in profiles:
        add(section, item, "mean", F.avg(c))
        tall = item in ("question_length", "sql_length")
        points = [50, *(PERCENTILES if tall else ())]
        aggs.append(F.percentile(c, F.array(*[F.lit(p / 100) for p in points])).alias(f"__{c}_at"))
        for i, p in enumerate(points):
            entries.append(((section, item, "median" if i == 0 else f"p{p}"), _at(f"__{c}_at", i)))
        add(section, item, "min", F.min(c))
        add(section, item, "max", F.max(c))
        if section == "length":
            add(section, item, "std", F.stddev_pop(c))
    for name, condition in checks.items():
        add("quality", name, "samples", F.count_if(condition))
    scalars = as_rows(
        base.groupBy(*by).agg(*aggs), by, entries, ("section", "item", "metric", "value")
    ).where("section <> 'quality' OR value > 0")

    words = keyword_frequency(df, len(TRACKED_KEYWORDS), by)
    keywords = as_rows(
        words, (*by, "keyword"),
        [(("samples",), F.col("samples").cast("double")), (("pct",), F.col("pct"))],
        ("metric", "value"),
    ).select(*by, F.lit("keyword").alias("section"), F.col("keyword").alias("item"), "metric", "value")
    tables = distinct_table_count(df, "schema", by).select(
        *by, F.lit("schema").alias("section"), F.lit("tables").alias("item"),
        F.lit("distinct").alias("metric"),
        F.col("unique_tables_count").cast("double").alias("value"),
    )
    return scalars.unionByName(keywords).unionByName(tables)
