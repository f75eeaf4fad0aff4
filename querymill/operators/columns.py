"""Optional columns and long-format reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def optional(df: DataFrame, name: str, dtype: str = "string") -> Column:
    """The column, or a typed null when the table does not have it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def text_field(df: DataFrame, name: str, default: str = "") -> Column:
    """Text of an optional column with a default for null or absent values."""
    return F.coalesce(optional(df, name), F.lit(default))


def as_rows(
    row: DataFrame, keys: Sequence[str], entries: Sequence[tuple[Sequence[str], Column]],
    names: Sequence[str],
) -> DataFrame:
    """Turn columns of an aggregated frame into rows.

    Each entry is a tuple of literal labels plus one value column; ``names`` names the labels and
    the value. ``keys`` are carried along.
    """
    structs = [
        F.struct(
            *[F.lit(label).alias(n) for label, n in zip(labels, names)],
            value.alias(names[-1]),
        )
        for labels, value in entries
    ]
    return row.select(*keys, F.inline(F.array(*structs)))


def percent(part: Column, whole: Column) -> Column:
    """``part`` in percent of ``whole``; 0 when there is nothing."""
    return F.when(whole > 0, part / whole * 100).otherwise(0.0)
