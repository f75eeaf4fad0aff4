"""Scans, cleaning, labelling, filtering."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as Q
from checks.registry import joined, query, rounded
from checks.views import RAW_CTE, raw_samples
from querymill.functions import cleaning, lexing
from querymill.functions.text import word_count
from querymill.operators import prepare, sampling
from querymill.plans import jobs
from querymill.storage import shared_folder, store
from querymill.sources import corpus


def processed(spark, sf_dir):
    return prepare.preprocess(sampling.assign_splits(raw_samples(spark, sf_dir)))


def kept(spark, sf_dir):
    return prepare.filter_samples(processed(spark, sf_dir))


def new_path(spark, name):
    """A path nobody has used, in the folder that the cluster shares."""
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


RAW = Q.with_(RAW_CTE)
PREP = Q.with_(Q.PREP)
_SPLIT = "CASE WHEN substr(md5('42|' || CAST(sample_id AS STRING)), 1, 8) < 'cccccccd' THEN 'train' WHEN substr(md5('42|' || CAST(sample_id AS STRING)), 1, 8) < 'e6666667' THEN 'validation' ELSE 'test' END"


@query("scan_raw_corpus", RAW + "SELECT sample_id, question, context, answer FROM raw")
def scan_raw(spark, sf_dir):
    path = new_path(spark, "raw")
    raw_samples(spark, sf_dir).write.parquet(path)
    return corpus.read_corpus(spark, path)


@query("scan_raw_split", RAW + f"SELECT sample_id, question, context, answer, {_SPLIT} AS split FROM raw WHERE {_SPLIT} = 'validation'")
def scan_split(spark, sf_dir):
    path = new_path(spark, "raw-json")
    sampling.assign_splits(raw_samples(spark, sf_dir)).write.json(path)
    return corpus.read_corpus(spark, path, split="validation", fmt="json")


@query("scan_first_rows", RAW + "SELECT sample_id, question, context, answer FROM raw ORDER BY sample_id LIMIT 100")
def scan_first(spark, sf_dir):
    return sampling.first_n(raw_samples(spark, sf_dir), 100)


@query("scan_processed_split", PREP + "SELECT sample_id, question, schema, sql, complexity, split FROM kept WHERE split = 'test'")
def scan_processed(spark, sf_dir):
    path = new_path(spark, "processed")
    corpus.write_processed(kept(spark, sf_dir), path)
    return corpus.read_processed(spark, path, "test").select(
        "sample_id", "question", "schema", "sql", "complexity", "split"
    )


@query("sink_processed_corpus", PREP + "SELECT sample_id, question, schema, sql, question_length, schema_length, sql_length, is_valid, complexity, split FROM kept")
def sink_processed(spark, sf_dir):
    path = new_path(spark, "processed")
    return jobs.prepare_corpus(raw_samples(spark, sf_dir), path).select(
        "sample_id", "question", "schema", "sql", "question_length", "schema_length",
        "sql_length", "is_valid", "complexity", "split",
    )


@query("scan_split_fallback", PREP + "SELECT sample_id, split FROM prepped WHERE split = 'validation'")
def split_fallback(spark, sf_dir):
    table = store(sampling.assign_splits(raw_samples(spark, sf_dir)).select("sample_id", "split"))
    return corpus.split_or_validation(table, "holdout")


@query("prep_clean_question", PREP + "SELECT sample_id, question FROM cleaned")
def clean_question(spark, sf_dir):
    raw = raw_samples(spark, sf_dir)
    return raw.select("sample_id", cleaning.clean_question(F.col("question")).alias("question"))


@query("prep_clean_schema", PREP + "SELECT sample_id, schema FROM cleaned")
def clean_schema(spark, sf_dir):
    raw = raw_samples(spark, sf_dir)
    return raw.select("sample_id", cleaning.clean_schema(F.col("context")).alias("schema"))


@query(
    "prep_clean_schema_short",
    PREP + """, cut AS (SELECT sample_id, substr(schema, 1, 160) AS c, schema FROM cleaned)
SELECT sample_id, CASE WHEN length(schema) <= 160 THEN schema
  WHEN length(regexp_extract(c, '^(.*)CREATE TABLE', 1, 's')) > 128
    THEN regexp_extract(c, '^(.*)CREATE TABLE', 1, 's') ELSE c END AS schema FROM cut""",
)
def clean_schema_short(spark, sf_dir):
    raw = raw_samples(spark, sf_dir)
    return raw.select("sample_id", cleaning.clean_schema(F.col("context"), 40).alias("schema"))


@query("prep_clean_sql", PREP + "SELECT sample_id, bare AS sql FROM cleaned")
def clean_sql(spark, sf_dir):
    raw = raw_samples(spark, sf_dir)
    return raw.select("sample_id", cleaning.clean_sql(F.col("answer"), False).alias("sql"))


@query("lex_normalise_layout", PREP + "SELECT sample_id, sql FROM normed")
def normalise_layout(spark, sf_dir):
    raw = raw_samples(spark, sf_dir)
    return raw.select("sample_id", cleaning.clean_sql(F.col("answer")).alias("sql"))


@query(
    "lex_tokens",
    RAW + f"SELECT sample_id, array_to_string({Q.tokens('answer')}, '|') AS tokens FROM raw",
)
def lex_tokens(spark, sf_dir):
    raw = raw_samples(spark, sf_dir)
    return raw.select("sample_id", joined(lexing.tokens(F.col("answer"))).alias("tokens"))


@query(
    "prep_word_counts",
    RAW + f"""SELECT sample_id, {Q.words("coalesce(question, '')")} AS question_length,
  {Q.words("coalesce(context, '')")} AS schema_length, {Q.words("coalesce(answer, '')")} AS sql_length
  FROM raw""",
)
def word_counts(spark, sf_dir):
    return raw_samples(spark, sf_dir).select(
        "sample_id",
        word_count(F.col("question")).alias("question_length"),
        word_count(F.col("context")).alias("schema_length"),
        word_count(F.col("answer")).alias("sql_length"),
    )


@query("prep_keywords", PREP + "SELECT sample_id, array_to_string(kws, '|') AS sql_keywords FROM prepped")
def keywords(spark, sf_dir):
    return processed(spark, sf_dir).select("sample_id", joined("sql_keywords").alias("sql_keywords"))


@query("prep_complexity", PREP + "SELECT sample_id, complexity FROM prepped")
def complexity(spark, sf_dir):
    return processed(spark, sf_dir).select("sample_id", "complexity")


@query(
    "prep_validate_raw",
    RAW + f"""SELECT sample_id, CASE WHEN {Q.strip("coalesce(question, '')")} = '' THEN 'Empty question'
    WHEN {Q.strip("coalesce(answer, '')")} = '' THEN 'Empty answer (SQL)' END AS validation_error,
  validation_error IS NULL AS is_valid FROM raw""",
)
def validate_raw(spark, sf_dir):
    return prepare.validate(raw_samples(spark, sf_dir)).select("sample_id", "validation_error", "is_valid")


@query(
    "prep_samples",
    PREP + """SELECT sample_id, question, schema, sql, question_length, schema_length, sql_length,
  is_valid, validation_error, array_to_string(kws, '|') AS sql_keywords, complexity FROM prepped""",
)
def prep_samples(spark, sf_dir):
    return processed(spark, sf_dir).select(
        "sample_id", "question", "schema", "sql", "question_length", "schema_length",
        "sql_length", "is_valid", "validation_error", joined("sql_keywords").alias("sql_keywords"),
        "complexity",
    )


@query("prep_missing_fields", RAW + "SELECT sample_id, coalesce(context, '') AS context, '' AS hint FROM raw")
def missing_fields(spark, sf_dir):
    raw = raw_samples(spark, sf_dir)
    return raw.select(
        "sample_id",
        prepare.text_field(raw, "context").alias("context"),
        prepare.text_field(raw, "hint").alias("hint"),
    )


@query("prep_evaluation_view", PREP + "SELECT sample_id, question, schema, sql, complexity FROM prepped")
def evaluation_view(spark, sf_dir):
    return prepare.evaluation_view(processed(spark, sf_dir))


@query("filter_valid", PREP + "SELECT sample_id, question, sql FROM prepped WHERE is_valid")
def filter_valid(spark, sf_dir):
    return prepare.keep_valid(processed(spark, sf_dir)).select("sample_id", "question", "sql")


@query(
    "filter_lengths",
    PREP + "SELECT sample_id, question_length, sql_length FROM prepped WHERE question_length BETWEEN 1 AND 8 AND sql_length BETWEEN 1 AND 12",
)
def filter_lengths(spark, sf_dir):
    opts = prepare.PrepareOptions(max_question_length=8, max_sql_length=12)
    return prepare.keep_within_lengths(processed(spark, sf_dir), opts).select(
        "sample_id", "question_length", "sql_length"
    )


@query(
    "filter_accounting",
    PREP + """SELECT (SELECT count(*) FROM prepped) AS before,
  (SELECT count(*) FROM prepped) - count(*) AS removed,
  round(100.0 * ((SELECT count(*) FROM prepped) - count(*)) / (SELECT count(*) FROM prepped), 6)::DOUBLE AS removed_pct,
  count(*) AS after FROM kept""",
)
def filter_accounting(spark, sf_dir):
    return rounded(prepare.filter_accounting(processed(spark, sf_dir)))


@query("filter_formattable", RAW + "SELECT sample_id, question FROM raw WHERE question <> ''")
def filter_formattable(spark, sf_dir):
    return prepare.drop_unformattable(raw_samples(spark, sf_dir)).select("sample_id", "question")


@query(
    "filter_minimum_lengths",
    PREP + "SELECT sample_id, question, sql FROM prepped WHERE length(question) >= 5 AND length(sql) >= 10 AND schema <> ''",
)
def filter_minimum(spark, sf_dir):
    return prepare.keep_above_minimum(processed(spark, sf_dir), require_schema=True).select(
        "sample_id", "question", "sql"
    )


@query(
    "profile_quality_issues",
    PREP + """, counts AS (
  SELECT 'invalid' AS issue, count(*) FILTER (NOT is_valid) AS samples FROM prepped
  UNION ALL SELECT 'empty_question', count(*) FILTER (trim(question) = '') FROM prepped
  UNION ALL SELECT 'empty_sql', count(*) FILTER (trim(sql) = '') FROM prepped
  UNION ALL SELECT 'empty_schema', count(*) FILTER (trim(schema) = '') FROM prepped
  UNION ALL SELECT 'short_question', count(*) FILTER (question_length < 3) FROM prepped
  UNION ALL SELECT 'long_sql', count(*) FILTER (sql_length > 100) FROM prepped)
SELECT issue, samples, round(100.0 * samples / (SELECT count(*) FROM prepped), 6)::DOUBLE AS pct
FROM counts WHERE samples > 0""",
)
def quality_issues(spark, sf_dir):
    return rounded(prepare.quality_issues(processed(spark, sf_dir)))


@query(
    "profile_prepared_levels",
    PREP + """SELECT complexity, count(*) AS samples, round(avg(question_length), 6) AS avg_question_length,
  round(avg(schema_length), 6) AS avg_schema_length, round(avg(sql_length), 6) AS avg_sql_length
  FROM kept GROUP BY complexity""",
)
def prepared_levels(spark, sf_dir):
    lengths = [F.avg(c).alias(f"avg_{c}") for c in ("question_length", "schema_length", "sql_length")]
    return rounded(
        kept(spark, sf_dir).groupBy("complexity").agg(F.count("*").alias("samples"), *lengths)
    )
