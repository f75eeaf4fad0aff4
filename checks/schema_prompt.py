"""CREATE TABLE text and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as Q
from checks.prep import PREP, RAW, kept
from checks.registry import joined, query
from checks.views import RAW_CTE, raw_samples
from querymill.functions import ddl, prompting
from querymill.functions.prompting import TEMPLATES, PromptOptions
from querymill.operators import formatting

DEFS = Q.with_(RAW_CTE + "," + Q.definitions("raw", "context"))


def _lit(text: str) -> str:
    """A Python text as a DuckDB expression."""
    lines = text.replace("'", "''").split("\n")
    return "'" + "' || chr(10) || '".join(lines) + "'"


@query(
    "ddl_schema_tables",
    DEFS + """, last AS (SELECT *, row_number() OVER (PARTITION BY sample_id, table_name ORDER BY pos DESC) AS r FROM defs)
SELECT sample_id, table_name, array_to_string(cols, '|') AS column_names FROM last WHERE r = 1""",
)
def schema_tables(spark, sf_dir):
    tables = raw_samples(spark, sf_dir).select(
        "sample_id", F.explode(ddl.schema_map(F.col("context"))).alias("table_name", "cols")
    )
    return tables.select("sample_id", "table_name", joined("cols").alias("column_names"))


@query(
    "ddl_uses_known_table",
    DEFS + """, known AS (SELECT sample_id, list(upper(table_name)) AS tables FROM defs GROUP BY sample_id)
SELECT r.sample_id, coalesce(list_has_any(tables, list_concat(
    regexp_extract_all(upper(answer), '\\bFROM\\s+[`"]?(\\w+)', 1),
    regexp_extract_all(upper(answer), '\\bJOIN\\s+[`"]?(\\w+)', 1))), false) AS known
FROM raw r LEFT JOIN known USING (sample_id)""",
)
def uses_known_table(spark, sf_dir):
    known = ddl.uses_known_table(F.col("answer"), ddl.known_tables(F.col("context")))
    return raw_samples(spark, sf_dir).select("sample_id", known.alias("known"))


_CUT = 120
_STATEMENTS = "regexp_extract_all(context, 'CREATE\\s+TABLE\\s+.*?;', 0, 'is')"


@query(
    "ddl_truncate_schema",
    RAW + f""", s AS (SELECT sample_id, context, {_STATEMENTS} AS st FROM raw),
fit AS (SELECT *, array_to_string([st[i] for i in range(1, len(st) + 1)
    if list_sum([length(y) + 1 for y in st[1:i]]) <= {_CUT}], chr(10)) AS kept FROM s)
SELECT sample_id, CASE WHEN length(context) <= {_CUT} THEN context WHEN len(st) = 0 THEN substr(context, 1, {_CUT})
  WHEN kept = '' THEN substr(st[1], 1, {_CUT}) ELSE kept END AS schema FROM fit""",
)
def truncate_schema(spark, sf_dir):
    return raw_samples(spark, sf_dir).select(
        "sample_id", ddl.truncate_schema(F.col("context"), _CUT).alias("schema")
    )


@query("ddl_split_statements", RAW + f"SELECT sample_id, unnest({_STATEMENTS}) AS statement FROM raw")
def split_statements(spark, sf_dir):
    return raw_samples(spark, sf_dir).select(
        "sample_id", F.explode(ddl.split_statements(F.col("context"))).alias("statement")
    )


@query(
    "ddl_table_count",
    RAW + f"SELECT sample_id, CAST(coalesce(len({_STATEMENTS}), 0) AS INTEGER) AS tables FROM raw",
)
def table_count(spark, sf_dir):
    return raw_samples(spark, sf_dir).select(
        "sample_id", ddl.table_count(F.col("context")).alias("tables")
    )


@query(
    "ddl_table_names",
    DEFS + """, names AS (SELECT sample_id, string_agg(table_name, '|' ORDER BY pos) AS table_names FROM defs GROUP BY sample_id)
SELECT r.sample_id, coalesce(table_names, '') AS table_names FROM raw r LEFT JOIN names USING (sample_id)""",
)
def table_names(spark, sf_dir):
    return raw_samples(spark, sf_dir).select(
        "sample_id", joined(ddl.table_names(F.col("context"))).alias("table_names")
    )


def _lines(x: str) -> str:
    return (
        f"array_to_string([l for l in [{Q.strip('m')} for m in string_split({x}, chr(10))] if l <> ''], chr(10))"
    )


@query("ddl_format_schema", RAW + f"""SELECT sample_id, {_lines("coalesce(context, '')")} AS schema FROM raw""")
def format_schema(spark, sf_dir):
    return raw_samples(spark, sf_dir).select(
        "sample_id", ddl.format_schema(F.col("context")).alias("schema")
    )


ROUGH_TABLES = "regexp_extract_all({0}, 'CREATE TABLE\\s+(?:IF NOT EXISTS\\s+)?(\\w+)', 1, 'i')"
ROUGH_COLUMNS = "regexp_extract_all({0}, '(\\w+)\\s+(?:INT|VARCHAR|TEXT|FLOAT|DOUBLE|DATE|BOOLEAN)', 1, 'i')"


@query(
    "ddl_rough_counts",
    PREP + f"""SELECT sample_id, CAST(len({ROUGH_TABLES.format('schema')}) AS INTEGER) AS tables,
  CAST(len({ROUGH_COLUMNS.format('schema')}) AS INTEGER) AS columns FROM kept""",
)
def rough_counts(spark, sf_dir):
    return kept(spark, sf_dir).select(
        "sample_id",
        F.size(ddl.rough_tables(F.col("schema"))).alias("tables"),
        ddl.rough_column_count(F.col("schema")).alias("columns"),
    )


@query(
    "ddl_schema_preview",
    PREP + """, p AS (SELECT sample_id, schema, 'CREATE TABLE' || string_split(
    coalesce(string_split(schema, 'CREATE TABLE')[2], schema), ';')[1] AS t FROM kept)
SELECT sample_id, CASE WHEN schema = '' THEN NULL WHEN length(t) > 60 THEN substr(t, 1, 60) || '...' ELSE t END AS preview FROM p""",
)
def schema_preview(spark, sf_dir):
    return kept(spark, sf_dir).select(
        "sample_id", ddl.schema_preview(F.col("schema"), 60).alias("preview")
    )


def _template_sql(name: str, question: str, schema: str, examples: str = "''") -> str:
    text = _lit(TEMPLATES[name])
    for key, value in (("question", question), ("schema", schema), ("examples", examples)):
        text = text.replace("{" + key + "}", f"' || {value} || '")
    return text


@query(
    "prompt_templates",
    " UNION ALL ".join(
        f"SELECT '{n}' AS name, o_orderkey AS id, {_template_sql(n, 'o_orderpriority', 'o_orderstatus')} AS prompt FROM orders"
        for n in TEMPLATES
        if n != "few_shot"
    ),
)
def templates(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    values = {"question": F.col("o_orderpriority"), "schema": F.col("o_orderstatus")}
    filled = F.array(
        *[
            F.struct(
                F.lit(n).alias("name"), prompting.fill_template(prompting.named_template(n), values).alias("prompt")
            )
            for n in TEMPLATES
            if n != "few_shot"
        ]
    )
    return orders.select(F.col("o_orderkey").alias("id"), F.inline(filled)).select("name", "id", "prompt")


def with_examples(spark, sf_dir):
    """Two examples per sample, written from its own columns."""
    example = F.struct(F.col("question"), F.col("answer"))
    second = F.struct(F.lit("How many tables").alias("question"), F.lit("SELECT 1").alias("answer"))
    return raw_samples(spark, sf_dir).withColumn("examples", F.array(example, second))


_BLOCK = (
    "'Examples:' || chr(10) || chr(10) || 'Example 1:' || chr(10) || 'Question: ' || question || chr(10)"
    " || 'SQL: ' || answer || chr(10) || chr(10) || 'Example 2:' || chr(10) || 'Question: How many tables'"
    " || chr(10) || 'SQL: SELECT 1'"
)


@query("prompt_few_shot_block", RAW + f"SELECT sample_id, {_BLOCK} AS examples FROM raw")
def few_shot_block(spark, sf_dir):
    return with_examples(spark, sf_dir).select(
        "sample_id", prompting.few_shot_block(F.col("examples")).alias("examples")
    )


@query(
    "prompt_few_shot",
    RAW + f"""SELECT sample_id, {_template_sql('few_shot', 'question', _lines("coalesce(context, '')"), _BLOCK)} AS prompt,
  question, context AS schema, answer AS reference, CASE WHEN context <> '' THEN context END AS context_schema FROM raw WHERE question <> ''""",
)
def few_shot(spark, sf_dir):
    opts = PromptOptions(template="few_shot", max_examples=3)
    rows = formatting.format_raw_samples(with_examples(spark, sf_dir), opts, "examples")
    return rows.withColumn("context_schema", F.col("context.schema")).drop("context")


_CUSTOM = "/* {schema} */ -- {question} {hint}"


@query(
    "prompt_custom_template",
    RAW + f"""SELECT sample_id, '/* ' || CASE WHEN sample_id IS NULL THEN '' ELSE {_lines("coalesce(context, '')")} END || ' */ -- ' || question || ' be brief' AS prompt FROM raw""",
)
def custom_template(spark, sf_dir):
    opts = PromptOptions(template=_CUSTOM)
    text = prompting.prompt(
        F.col("question"), F.col("context"), opts=opts, extra={"hint": F.lit("be brief")}
    )
    return raw_samples(spark, sf_dir).select("sample_id", text.alias("prompt"))


@query(
    "prompt_rows",
    PREP + f"""SELECT sample_id, {_template_sql('default', 'question', 'schema')} AS prompt, question, schema,
  sql AS reference, CASE WHEN schema <> '' THEN schema END AS context_schema, complexity, is_valid FROM prepped WHERE question <> ''""",
)
def prompt_rows(spark, sf_dir):
    from checks.prep import processed

    rows = formatting.format_samples(processed(spark, sf_dir))
    return rows.select(
        "sample_id", "prompt", "question", "schema", "reference",
        F.col("context.schema").alias("context_schema"), "complexity", "is_valid",
    )


@query(
    "prompt_raw_rows",
    RAW + f"""SELECT sample_id, {_template_sql('instructional', 'question', _lines("coalesce(context, '')"))} AS prompt,
  question, context AS schema, answer AS reference FROM raw WHERE question <> ''""",
)
def prompt_raw_rows(spark, sf_dir):
    rows = formatting.format_raw_samples(
        raw_samples(spark, sf_dir), PromptOptions(template="instructional")
    )
    return rows.drop("context")


def _tidied_and_cut() -> str:
    """The default prompt over the tidied schema, cut at whole statements."""
    return f"""{RAW}, tidy AS (SELECT sample_id, question, {_lines("coalesce(context, '')")} AS context FROM raw),
s AS (SELECT *, {_STATEMENTS} AS st FROM tidy),
fit AS (SELECT *, array_to_string([st[i] for i in range(1, len(st) + 1)
    if list_sum([length(y) + 1 for y in st[1:i]]) <= {_CUT}], chr(10)) AS kept FROM s),
cut AS (SELECT sample_id, question, CASE WHEN length(context) <= {_CUT} THEN context
    WHEN len(st) = 0 THEN substr(context, 1, {_CUT}) WHEN kept = '' THEN substr(st[1], 1, {_CUT}) ELSE kept END AS schema FROM fit)
SELECT sample_id, {_template_sql('default', 'question', 'schema')} AS prompt FROM cut WHERE question <> ''"""


@query("prompt_truncated_schema", _tidied_and_cut())
def prompt_truncated_schema(spark, sf_dir):
    rows = formatting.format_raw_samples(
        raw_samples(spark, sf_dir), PromptOptions(max_schema_length=_CUT)
    )
    return rows.select("sample_id", "prompt")
