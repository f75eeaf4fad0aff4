"""Reading CREATE TABLE text: tables, columns, statements, truncation, preview."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querymill.functions.text import WS, bind, or_empty, strip

# The column types that make a definition recognisable. They match as prefixes.
COLUMN_TYPES = (
    "VARCHAR", "DATETIME", "TIMESTAMP", "INTEGER", "DECIMAL", "NUMERIC", "BOOLEAN", "DOUBLE",
    "FLOAT", "REAL", "CHAR", "TEXT", "TIME", "DATE", "INT", "BOOL", "BLOB", "CLOB",
)
# The shorter type list behind the rough column count.
ROUGH_TYPES = ("INT", "VARCHAR", "TEXT", "FLOAT", "DOUBLE", "DATE", "BOOLEAN")

_Q = "[`\"]?"
TABLE = (
    rf"(?iU)CREATE{WS}+TABLE{WS}+(?:IF{WS}+NOT{WS}+EXISTS{WS}+)?{_Q}(\w+){_Q}{WS}*\(([^;]*)\)"
)
COLUMN = rf"(?iU)^{_Q}(\w+){_Q}{WS}+(?:{'|'.join(COLUMN_TYPES)})"
STATEMENT = rf"(?is)CREATE{WS}+TABLE{WS}+.*?;"
ROUGH_TABLE = rf"(?iU)CREATE TABLE{WS}+(?:IF NOT EXISTS{WS}+)?(\w+)"
# The whitespace between a name and its type; the name must not lie inside the match before.
ROUGH_COLUMN = rf"(?iU)(?![!-~])(?<=\w)(?!\G){WS}++(?:{'|'.join(ROUGH_TYPES)})"


def _definitions(context: Column) -> Column:
    """One struct per CREATE TABLE with at least one recognised column, in text order."""
    text = or_empty(context)
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(TABLE), F.lit(1)).alias("name"),
        F.regexp_extract_all(text, F.lit(TABLE), F.lit(2)).alias("body"),
    )

    def read(entry: Column) -> Column:
        names = F.transform(
            F.split(entry["body"], ","), lambda d: F.regexp_extract(strip(d), COLUMN, 1)
        )
        return F.struct(
            entry["name"].alias("table_name"), F.array_remove(names, "").alias("column_names")
        )

    return F.filter(F.transform(found, read), lambda e: F.size(e["column_names"]) > 0)


def schema_tables(context: Column) -> Column:
    """``array<struct<table_name, column_names>>``; a repeated name keeps its last definition."""
    def last_only(defs: Column) -> Column:
        later = F.reverse(F.transform(defs, lambda e: e["table_name"]))
        return bind(
            later,
            lambda names: F.filter(
                defs, lambda e, i: F.array_position(names, e["table_name"]) == F.size(names) - i
            ),
        )

    return bind(_definitions(context), last_only)


def schema_map(context: Column) -> Column:
    return F.map_from_entries(schema_tables(context))


def table_names(context: Column) -> Column:
    """Names in order of first appearance."""
    return F.array_distinct(F.transform(_definitions(context), lambda e: e["table_name"]))


def known_tables(context: Column) -> Column:
    """Upper-cased table names, the form the schema check compares with."""
    return F.array_distinct(F.transform(_definitions(context), lambda e: F.upper(e["table_name"])))


def query_tables(sql: Column) -> Column:
    """Upper-cased names that follow FROM or JOIN."""
    up = F.upper(or_empty(sql))
    hits = [
        F.regexp_extract_all(up, F.lit(rf"(?U)\b{word}{WS}+{_Q}(\w+)"), F.lit(1))
        for word in ("FROM", "JOIN")
    ]
    return F.concat(*hits)


def uses_known_table(sql: Column, tables: Column) -> Column:
    """Does the query touch at least one of ``tables`` (upper-case names)?"""
    return F.coalesce(F.arrays_overlap(query_tables(sql), tables), F.lit(False))


def split_statements(context: Column) -> Column:
    return F.regexp_extract_all(or_empty(context), F.lit(STATEMENT), F.lit(0))


def table_count(context: Column) -> Column:
    return F.size(split_statements(context))


def truncate_schema(context: Column, max_length: int = 1024) -> Column:
    """Leading whole statements that fit; the first one is cut when not even it fits."""
    statements = split_statements(context)

    def take(acc: Column, stmt: Column) -> Column:
        text = F.concat(acc["text"], stmt, F.lit("\n"))
        fits = ~acc["full"] & (F.length(text) <= max_length)
        return F.struct(
            F.when(fits, text).otherwise(acc["text"]).alias("text"), (~fits).alias("full")
        )

    empty = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))
    kept = strip(F.aggregate(statements, empty, take, lambda acc: acc["text"]))
    shortened = (
        F.when(F.size(statements) == 0, F.substring(context, 1, max_length))
        .when(kept == "", F.substring(F.get(statements, F.lit(0)), 1, max_length))
        .otherwise(kept)
    )
    return F.when(F.length(context) > max_length, shortened).otherwise(context)


def format_schema(context: Column) -> Column:
    """Lines stripped, blank lines dropped."""
    return F.regexp_replace(strip(or_empty(context)), rf"{WS}*\n{WS}*", "\n")


def rough_tables(schema: Column) -> Column:
    return F.regexp_extract_all(or_empty(schema), F.lit(ROUGH_TABLE), F.lit(1))


def rough_column_count(schema: Column) -> Column:
    return F.regexp_count(or_empty(schema), F.lit(ROUGH_COLUMN))


def schema_preview(schema: Column, max_length: int = 200) -> Column:
    """First table definition, shortened with an ellipsis; null for an empty schema."""
    first = F.coalesce(F.get(F.split(schema, "CREATE TABLE"), F.lit(1)), schema)
    text = F.concat(F.lit("CREATE TABLE"), F.substring_index(first, ";", 1))
    short = F.concat(F.substring(text, 1, max_length), F.lit("..."))
    shown = F.when(F.length(text) > max_length, short).otherwise(text)
    return F.when(or_empty(schema) != "", shown)
