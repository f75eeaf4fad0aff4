"""Working columns beside input columns of the same names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def set_aside(df: DataFrame, working: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named like a working column renamed, and new name by old for renaming back.

    Names are compared without case.
    """
    taken, names = {w.lower() for w in working}, {c.lower() for c in df.columns}
    moved: dict[str, str] = {}
    for column in df.columns:
        if column.lower() in taken:
            new = f"aside_{column}"
            while new.lower() in names | taken:
                new += "_"
            moved[column] = new
            names.add(new.lower())
    return df.withColumnsRenamed(moved), moved


def put_back(df: DataFrame, moved: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({new: old for old, new in moved.items()})
