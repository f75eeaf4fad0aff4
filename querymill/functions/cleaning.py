"""Cleaning, validation and labelling of question / schema / SQL texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querymill.functions.lexing import normalise_layout
from querymill.functions.text import (
    bind,
    collapse,
    contains_any,
    found_words,
    is_blank,
    occurrences,
    or_empty,
)

# The two kinds of comments.
_LINE_COMMENT = r"--[^\n]*"
_BLOCK_COMMENT = r"(?s)/\*.*?\*/"

# Keywords listed per sample, tested as substrings in this order.
SAMPLE_KEYWORDS = (
    "SELECT", "FROM", "WHERE", "JOIN", "INNER JOIN", "LEFT JOIN", "RIGHT JOIN", "OUTER JOIN",
    "GROUP BY", "ORDER BY", "HAVING", "LIMIT", "OFFSET", "UNION", "DISTINCT", "COUNT", "SUM",
    "AVG", "MAX", "MIN", "AS", "IN", "BETWEEN", "LIKE", "AND", "OR", "NOT",
)

LEVELS = ("simple", "medium", "complex")


def clean_question(question: Column) -> Column:
    plain = F.translate(collapse(or_empty(question)), "’“”", "'\"\"")
    ended = (plain == "") | F.endswith(plain, F.lit(".")) | F.endswith(plain, F.lit("?"))
    ended = ended | F.endswith(plain, F.lit("!"))
    return F.when(ended, plain).otherwise(F.concat(plain, F.lit("?")))


def drop_comments(text: Column) -> Column:
    """Texts without the two characters that open a comment are not gone through by the patterns."""
    def dropped(mark: str, pattern: str):
        return lambda t: F.when(F.contains(t, F.lit(mark)), F.regexp_replace(t, pattern, "")).otherwise(t)

    return bind(bind(text, dropped("--", _LINE_COMMENT)), dropped("/*", _BLOCK_COMMENT))


def clean_schema(context: Column, max_length: int | None = None) -> Column:
    """Comments dropped, whitespace collapsed; with ``max_length``, cut to four characters per token.

    A cut that leaves a partial last table (its CREATE TABLE lies in the last fifth) goes back to
    the start of that table.
    """
    text = collapse(drop_comments(or_empty(context)))
    if max_length is None:
        return text
    limit = 4 * max_length
    cut = F.substring(text, 1, limit)
    head = F.regexp_extract(cut, r"(?s)^(.*)CREATE TABLE", 1)
    at_table = F.when(F.length(head) > F.lit(limit * 0.8), head).otherwise(cut)
    return F.when(F.length(text) > limit, at_table).otherwise(text)


def clean_sql(sql: Column, normalise: bool = True) -> Column:
    text = collapse(drop_comments(or_empty(sql)))
    return normalise_layout(text) if normalise else text


def sample_keywords(sql: Column) -> Column:
    return found_words(F.upper(sql), SAMPLE_KEYWORDS)


def complexity_level(sql: Column) -> Column:
    """Corpus label from substring counts: simple, medium or complex."""
    up = F.upper(or_empty(sql))
    joins = occurrences(up, "JOIN")
    inner_selects = occurrences(up, "SELECT") - 1
    with_cte = F.contains(up, F.lit("WITH")) & F.contains(up, F.lit("AS"))
    return (
        F.when(with_cte | (joins >= 2) | (inner_selects >= 2), "complex")
        .when(
            (joins >= 1) | (inner_selects >= 1) | contains_any(up, ("GROUP BY", "HAVING", "UNION")),
            "medium",
        )
        .otherwise("simple")
    )


# The texts of validation errors.
def validation_error(question: Column, answer: Column, missing: str | None = None) -> Column:
    """First problem of a sample, null when it is valid. ``missing`` names an absent column."""
    if missing:
        return F.lit(f"Missing required field: {missing}")
    return F.when(is_blank(question), "Empty question").when(is_blank(answer), "Empty answer (SQL)")
