"""Corpus preparation: clean, validate, label and filter question / schema / SQL samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.functions import cleaning
from querymill.functions.text import clean_word_count, computed_once, is_blank, or_empty
from querymill.operators.columns import as_rows, optional, percent, text_field


@dataclass(frozen=True)
class PrepareOptions:
    max_question_length: int = 512
    max_schema_length: int | None = None
    max_sql_length: int = 512
    normalize_sql: bool = True
    filter_invalid: bool = True


def preprocess(df: DataFrame, opts: PrepareOptions = PrepareOptions()) -> DataFrame:
    """Add the cleaned texts, lengths, validity, keywords and complexity label.

    Other columns stay. ``question`` is overwritten, ``context`` and ``answer`` are kept. The three
    texts are cleaned in one projection and everything else reads the cleaned columns. Filter on
    source columns (such as ``split``) before this step.
    """
    cleaned = df.withColumns(
        {
            "question": cleaning.clean_question(text_field(df, "question")),
            "schema": cleaning.clean_schema(text_field(df, "context"), opts.max_schema_length),
            "sql": computed_once(
                cleaning.clean_sql(text_field(df, "answer"), opts.normalize_sql)
            ),
        }
    )
    error = cleaning.validation_error(F.col("question"), F.col("sql"))
    return cleaned.withColumns(
        {
            "question_length": clean_word_count(F.col("question")),
            "schema_length": clean_word_count(F.col("schema")),
            "sql_length": clean_word_count(F.col("sql")),
            "is_valid": error.isNull(),
            "validation_error": error,
            "sql_keywords": computed_once(cleaning.sample_keywords(F.col("sql"))),
            "complexity": cleaning.complexity_level(F.col("sql")),
        }
    )


def validate(df: DataFrame) -> DataFrame:
    """Validity of raw samples, including the check for required columns."""
    absent = [c for c in ("question", "context", "answer") if c not in df.columns]
    error = cleaning.validation_error(
        optional(df, "question"), optional(df, "answer"), absent[0] if absent else None
    )
    return df.withColumn("validation_error", error).withColumn(
        "is_valid", F.col("validation_error").isNull()
    )


def within_lengths(opts: PrepareOptions = PrepareOptions()) -> Column:
    return F.col("question_length").between(1, opts.max_question_length) & F.col(
        "sql_length"
    ).between(1, opts.max_sql_length)


def keep_valid(df: DataFrame) -> DataFrame:
    return df.where("is_valid")


def keep_within_lengths(df: DataFrame, opts: PrepareOptions = PrepareOptions()) -> DataFrame:
    return df.where(within_lengths(opts))


def filter_samples(df: DataFrame, opts: PrepareOptions = PrepareOptions()) -> DataFrame:
    return df.where(F.col("is_valid") & within_lengths(opts))


def filter_accounting(df: DataFrame, opts: PrepareOptions = PrepareOptions()) -> DataFrame:
    """One row: samples before, removed, removed in percent, after."""
    kept = F.col("is_valid") & within_lengths(opts)
    counts = df.agg(F.count("*").alias("before"), F.count_if(kept).alias("after"))
    removed = F.col("before") - F.col("after")
    return counts.select(
        "before",
        removed.alias("removed"),
        percent(removed, F.col("before")).alias("removed_pct"),
        "after",
    )


def drop_unformattable(df: DataFrame) -> DataFrame:
    """Rows without a question cannot become prompts."""
    return df.where(text_field(df, "question") != "")


def keep_above_minimum(
    df: DataFrame,
    min_question_length: int = 5,
    min_sql_length: int = 10,
    require_schema: bool = False,
) -> DataFrame:
    """Optional lower bounds, in characters."""
    keep = (F.length(text_field(df, "question")) >= min_question_length) & (
        F.length(text_field(df, "sql")) >= min_sql_length
    )
    if require_schema:
        keep = keep & ~is_blank(optional(df, "schema"))
    return df.where(keep)


def quality_conditions(df: DataFrame) -> dict[str, Column]:
    """The quality predicates that the columns of ``df`` allow."""
    out: dict[str, Column] = {}
    if "is_valid" in df.columns:
        out["invalid"] = ~F.coalesce(F.col("is_valid"), F.lit(False))
    for name in ("question", "sql", "schema"):
        if name in df.columns:
            out[f"empty_{name}"] = is_blank(F.col(name))
    if "question_length" in df.columns:
        out["short_question"] = F.col("question_length") < 3
    if "sql_length" in df.columns:
        out["long_sql"] = F.col("sql_length") > 100
    return out


def quality_issues(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``issue, samples, pct`` for every predicate that some sample meets, in one pass."""
    conditions = quality_conditions(df)
    counts = df.groupBy(*by).agg(
        F.count("*").alias("__all"), *[F.count_if(c).alias(n) for n, c in conditions.items()]
    )
    rows = as_rows(
        counts, (*by, "__all"), [((n,), F.col(n)) for n in conditions], ("issue", "samples")
    )
    return rows.where("samples > 0").select(
        *by, "issue", "samples", percent(F.col("samples"), F.col("__all")).alias("pct")
    )


def evaluation_view(df: DataFrame) -> DataFrame:
    """``sample_id, question, schema, sql, complexity`` with ``unknown`` for a missing label."""
    return df.select(
        "sample_id",
        "question",
        optional(df, "schema").alias("schema"),
        or_empty(F.col("sql")).alias("sql"),
        text_field(df, "complexity", "unknown").alias("complexity"),
    )
