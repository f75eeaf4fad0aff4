"""Prompt columns over a table of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.functions.prompting import PromptOptions, placeholders, prompt
from querymill.functions.text import or_empty
from querymill.operators.columns import optional, text_field
from querymill.operators.prepare import drop_unformattable

PRESERVED = ("complexity", "sql_keywords", "is_valid")


def _examples(df: DataFrame, examples: str | None) -> Column | None:
    return F.col(examples) if examples else None


def _usable(df: DataFrame, opts: PromptOptions, examples: str | None) -> DataFrame:
    """Rows that can be formatted: a question, and examples where the template asks for them."""
    df = drop_unformattable(df)
    if examples and "examples" in placeholders(opts.text):
        df = df.where(F.size(F.coalesce(F.col(examples), F.array())) > 0)
    return df


def _schema_struct(schema: Column) -> Column:
    return F.when(or_empty(schema) != "", F.struct(schema.alias("schema")))


def format_samples(
    df: DataFrame,
    opts: PromptOptions = PromptOptions(),
    examples: str | None = None,
    include_reference: bool = True,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Training rows from processed samples (``question``, ``schema``, ``sql``)."""
    df = _usable(df, opts, examples)
    schema = text_field(df, "schema")
    keys = [c for c in ("sample_id", "split") if c in df.columns]
    columns = [
        prompt(F.col("question"), schema, _examples(df, examples), opts, extra).alias("prompt"),
        F.col("question"),
        schema.alias("schema"),
    ]
    if include_reference:
        columns.append(text_field(df, "sql").alias("reference"))
    columns.append(_schema_struct(schema).alias("context"))
    return df.select(*keys, *columns, *[c for c in PRESERVED if c in df.columns])


def format_raw_samples(
    df: DataFrame, opts: PromptOptions = PromptOptions(), examples: str | None = None
) -> DataFrame:
    """The same straight from raw samples (``question``, ``context``, ``answer``), uncleaned."""
    df = _usable(df, opts, examples)
    schema = optional(df, "context")
    keys = [c for c in ("sample_id",) if c in df.columns]
    return df.select(
        *keys,
        prompt(F.col("question"), schema, _examples(df, examples), opts).alias("prompt"),
        "question",
        schema.alias("schema"),
        text_field(df, "answer").alias("reference"),
        _schema_struct(schema).alias("context"),
    )
