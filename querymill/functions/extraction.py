"""Pulling the SQL text out of a model response.

``add_extraction`` is staged: each intermediate text is a column of its own, so that it is
computed once per row however often later steps mention it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.functions.text import (
    WS,
    computed_once,
    contains_any,
    or_empty,
    single_spaced,
    strip,
    strip_column,
)

# Words that open a query. The order decides which one wins inside prose.
OPENING_KEYWORDS = (
    "SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER", "TRUNCATE", "WITH",
    "EXPLAIN", "DESCRIBE", "SHOW",
)
# Texts that end a raw query.
END_MARKERS = ("\n\n", "\nExplanation:", "\nNote:", "\nThis query", "\nThe above")

# Word pairs that give SQL away, with the regex between and after them. The pairs
# double as a cheap substring test in front of the regex.
_SHAPES = (
    (("SELECT", "FROM"), r"\bSELECT\b[^\n]*\bFROM\b"),
    (("INSERT", "INTO"), rf"\bINSERT{WS}+INTO\b"),
    (("UPDATE", "SET"), r"\bUPDATE\b[^\n]*\bSET\b"),
    (("DELETE", "FROM"), rf"\bDELETE{WS}+FROM\b"),
    (("CREATE",), rf"\bCREATE{WS}+(?:TABLE|DATABASE|INDEX|VIEW)\b"),
)

# The fenced block and the inline span.
FENCE = rf"(?is)```(?:sql)?{WS}*\n(.*?)```"
SPAN = r"`([^`]+)`"


@dataclass(frozen=True)
class ParserOptions:
    """``max_sql_length`` cuts extracted texts; by default they stay whole.

    ``max_response_length`` belongs to the scoring rule: longer responses count as badly formatted
    (None: no such rule).
    """

    max_sql_length: int | None = None
    min_sql_length: int = 10
    max_response_length: int | None = 4096
    extract_code_blocks: bool = True
    clean_whitespace: bool = True


def clean_extracted(sql: Column, opts: ParserOptions = ParserOptions()) -> Column:
    """Label prefix off, whitespace collapsed, " ;" closed up."""
    out = F.regexp_replace(sql, rf"(?i)^(?:SQL:|Query:|Answer:){WS}*", "")
    if opts.clean_whitespace:
        out = F.trim(F.replace(single_spaced(out), F.lit(" ;"), F.lit(";")))  # spaces are all that is left
    else:
        out = strip(out)
    return out if opts.max_sql_length is None else F.substring(out, 1, opts.max_sql_length)


def looks_like_sql(text: Column, up: Column | None = None) -> Column:
    """``up`` is the stripped, upper-cased text where the caller already has it."""
    up = F.upper(strip(text)) if up is None else up
    cond = F.lit(False)
    for word in OPENING_KEYWORDS:
        cond = cond | F.startswith(up, F.lit(word))
    for words, shape in _SHAPES:
        probe = F.lit(True)
        for word in words:
            probe = probe & F.contains(up, F.lit(word))
        cond = cond | (probe & text.rlike("(?iU)" + shape))
    return cond


# The steps below return "" where they find nothing; ``add_extraction`` chains them.


def from_code_block(text: Column, opts: ParserOptions = ParserOptions()) -> Column:
    """First fenced block."""
    body = strip(F.regexp_extract(text, FENCE, 1))
    return F.when(F.contains(text, F.lit("```")), clean_extracted(body, opts)).otherwise("")


def from_inline_code(text: Column, opts: ParserOptions = ParserOptions()) -> Column:
    """First `span` that looks like SQL."""
    spans = F.transform(
        F.regexp_extract_all(text, F.lit(SPAN), F.lit(1)),
        lambda s: F.struct(strip(s).alias("text"), F.upper(strip(s)).alias("up")),
    )
    sql_spans = F.filter(spans, lambda e: looks_like_sql(e["text"], e["up"]))
    first = or_empty(F.get(sql_spans, F.lit(0))["text"])
    return F.when(F.contains(text, F.lit("`")), clean_extracted(first, opts)).otherwise("")


def until_end(text: Column) -> Column:
    """Cut at the earliest end marker. Cutting marker by marker ends at the same place."""
    out = text
    for marker in END_MARKERS:
        out = F.substring_index(out, marker, 1)
    return strip(out)


def raw_start(text: Column, up: Column | None = None) -> Column:
    """The text itself if it looks like SQL, else from the first opening keyword in list order."""
    up = F.upper(text) if up is None else up
    start = F.when(looks_like_sql(text, up), text)
    for word in OPENING_KEYWORDS:
        whole_word = rf"(?iU)\b{word}\b"
        start = start.when(
            F.contains(up, F.lit(word)) & text.rlike(whole_word),
            F.regexp_extract(text, rf"(?isU)\b{word}\b.*", 0),
        )
    return start.otherwise("")


def from_raw_text(text: Column, opts: ParserOptions = ParserOptions()) -> Column:
    return clean_extracted(until_end(raw_start(text)), opts)


def add_extraction(
    df: DataFrame,
    response: str = "response",
    opts: ParserOptions = ParserOptions(),
    into: str = "extracted_sql",
) -> DataFrame:
    """Add ``into`` (fenced block, else inline code, else raw SQL, else null)."""
    names = [f"__{into}_{s}" for s in ("text", "up", "fenced", "spanned", "raw")]
    text, up, fenced, spanned, raw = (F.col(n) for n in names)
    block = from_code_block(text, opts) if opts.extract_code_blocks else F.lit("")
    df = df.withColumn(names[0], strip_column(or_empty(F.col(response))))
    df = df.withColumns({names[1]: F.upper(text), names[2]: block})
    df = df.withColumn(names[3], F.when(fenced == "", from_inline_code(text, opts)).otherwise(fenced))
    df = df.withColumn(
        names[4],
        F.when(spanned == "", clean_extracted(until_end(raw_start(text, up)), opts)).otherwise(spanned),
    )
    return df.withColumn(into, computed_once(F.when(raw != "", raw))).drop(*names)


def valid_format(
    response: Column, extracted: Column, opts: ParserOptions = ParserOptions()
) -> Column:
    size = F.length(strip_column(or_empty(response)))
    in_range = size >= opts.min_sql_length
    if opts.max_response_length is not None:
        in_range = in_range & (size <= opts.max_response_length)
    return in_range & (F.coalesce(F.length(extracted), F.lit(0)) >= opts.min_sql_length)


def parsed_response(
    response: Column, extracted: Column, opts: ParserOptions = ParserOptions()
) -> Column:
    """``struct<sql, valid, metadata>`` of a response whose SQL was already extracted."""
    has_sql = extracted.isNotNull()
    error = F.when(or_empty(response) == "", "Empty response").when(~has_sql, "Failed to extract SQL")
    metadata = F.struct(
        error.alias("error"),
        F.when(has_sql, response).alias("original_response"),
        F.length(extracted).alias("extracted_length"),
    )
    return F.struct(
        extracted.alias("sql"),
        (has_sql & valid_format(response, extracted, opts)).alias("valid"),
        metadata.alias("metadata"),
    )


def mentions_query_type(up: Column) -> Column:
    # The five statement verbs the rubric looks for.
    return contains_any(up, ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE"))
