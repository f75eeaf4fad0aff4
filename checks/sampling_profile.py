"""Splits, samples, corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as Q
from checks.prep import _SPLIT, PREP, RAW, kept, processed
from checks.registry import query, rounded
from checks.schema_prompt import ROUGH_COLUMNS, ROUGH_TABLES
from checks.views import raw_samples
from querymill.functions.prompting import PromptOptions
from querymill.operators import formatting, profile, report_states, sampling
from querymill.operators.profile import TRACKED_KEYWORDS
from querymill.plans import jobs
from querymill.storage import store

KEY = "md5('42|' || CAST(sample_id AS STRING))"


def stored(spark, sf_dir, which=kept):
    """The processed corpus at rest: sampling and profiling read it more than once."""
    return store(which(spark, sf_dir), "processed")


@query("split_hash", RAW + f"SELECT sample_id, {_SPLIT} AS split FROM raw")
def split_hash(spark, sf_dir):
    return sampling.assign_splits(raw_samples(spark, sf_dir)).select("sample_id", "split")


_CUTS = """held AS (SELECT *, ceil(round(n * 0.2, 6)) AS rest FROM ranked),
cut AS (SELECT *, ceil(round(rest * 0.5, 6)) AS test FROM held)
SELECT sample_id, {extra}CASE WHEN r <= n - rest THEN 'train' WHEN r <= n - test THEN 'validation' ELSE 'test' END AS split FROM cut"""


@query(
    "split_exact",
    RAW + f", ranked AS (SELECT sample_id, row_number() OVER (ORDER BY {KEY}) AS r, count(*) OVER () AS n FROM raw), "
    + _CUTS.format(extra=""),
)
def split_exact(spark, sf_dir):
    return sampling.exact_splits(raw_samples(spark, sf_dir)).select("sample_id", "split")


@query(
    "split_stratified",
    PREP + f""", ranked AS (SELECT sample_id, complexity, row_number() OVER (PARTITION BY complexity ORDER BY {KEY}) AS r,
  count(*) OVER (PARTITION BY complexity) AS n FROM kept), """
    + _CUTS.format(extra="complexity, "),
)
def split_stratified(spark, sf_dir):
    df = stored(spark, sf_dir).drop("split")
    return sampling.exact_splits(df, stratify_by="complexity").select(
        "sample_id", "complexity", "split"
    )


@query(
    "split_policy",
    RAW + f"""SELECT 'kept' AS policy, sample_id, CASE WHEN sample_id < 10 THEN 'test' ELSE 'train' END AS split FROM raw
UNION ALL SELECT 'created', sample_id, {_SPLIT} FROM raw UNION ALL SELECT 'none', sample_id, 'train' FROM raw""",
)
def split_policy(spark, sf_dir):
    raw = raw_samples(spark, sf_dir)
    given = raw.withColumn("split", F.when(F.col("sample_id") < 10, "test").otherwise("train"))
    parts = [
        sampling.ensure_splits(df, create).select(F.lit(name).alias("policy"), "sample_id", "split")
        for name, df, create in (("kept", given, True), ("created", raw, True), ("none", raw, False))
    ]
    return parts[0].union(parts[1]).union(parts[2])


_SHARES = """, lv AS (SELECT complexity, count(*) AS c, sum(count(*)) OVER () AS total FROM kept GROUP BY 1),
al AS (SELECT complexity, c, greatest(1, floor({n} * (c / total)))::BIGINT AS share FROM lv),
quota AS (SELECT complexity, share + CASE WHEN row_number() OVER (ORDER BY c DESC,
    CASE complexity WHEN 'simple' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) = 1
  THEN greatest(0, {n} - sum(share) OVER ()) ELSE 0 END AS q FROM al),
numbered AS (SELECT sample_id, complexity, row_number() OVER (PARTITION BY complexity ORDER BY """ + KEY + """) AS r FROM kept)
SELECT sample_id, complexity FROM numbered JOIN quota USING (complexity) WHERE r <= q"""


@query("sample_evaluation_set", PREP + _SHARES.format(n=100))
def evaluation_set(spark, sf_dir):
    df = stored(spark, sf_dir).select("sample_id", "complexity")
    return sampling.evaluation_set(df, 100)


@query("sample_evaluation_set_large", PREP + _SHARES.format(n=12000))
def evaluation_set_large(spark, sf_dir):
    df = stored(spark, sf_dir).select("sample_id", "complexity")
    return sampling.evaluation_set(df, 12000)


@query("sample_first_large", RAW + "SELECT sample_id, question FROM raw ORDER BY sample_id LIMIT 12345")
def first_large(spark, sf_dir):
    rows = raw_samples(spark, sf_dir).select("sample_id", "question")
    return sampling.first_n(rows, 12345)


@query("sample_uniform", RAW + f"SELECT sample_id, question FROM raw ORDER BY {KEY} LIMIT 1000")
def uniform(spark, sf_dir):
    return sampling.uniform_sample(raw_samples(spark, sf_dir), 1000).select("sample_id", "question")


@query("sample_uniform_large", RAW + f"SELECT sample_id, question FROM raw ORDER BY {KEY} LIMIT 12345")
def uniform_large(spark, sf_dir):
    return sampling.uniform_sample(raw_samples(spark, sf_dir), 12345).select("sample_id", "question")


@query(
    "sample_per_level",
    PREP + f""", numbered AS (SELECT *, row_number() OVER (PARTITION BY complexity ORDER BY {KEY}) AS r FROM kept)
SELECT sample_id, question, sql, complexity FROM numbered WHERE r <= 2""",
)
def per_level(spark, sf_dir):
    return sampling.examples_per_level(kept(spark, sf_dir), 2).select(
        "sample_id", "question", "sql", "complexity"
    )


@query(
    "sample_per_step",
    RAW + "SELECT sample_id FROM raw ORDER BY md5('42|500|' || CAST(sample_id AS STRING)) LIMIT 50",
)
def per_step(spark, sf_dir):
    return sampling.step_sample(raw_samples(spark, sf_dir), 50, 500).select("sample_id")


def _stats(name: str, column: str) -> str:
    n = Q.words(f"coalesce({column}, '')")
    return (
        f"round(avg({n}), 6) AS avg_{name}_length, median({n})::DOUBLE AS median_{name}_length,"
        f" max({n}) AS max_{name}_length"
    )


@query(
    "profile_corpus_statistics",
    RAW + f"SELECT count(*) AS total_samples, {_stats('question', 'question')}, {_stats('sql', 'answer')}, {_stats('schema', 'context')} FROM raw",
)
def corpus_statistics(spark, sf_dir):
    return rounded(profile.corpus_statistics(raw_samples(spark, sf_dir)))


@query(
    "profile_distinct_tables",
    RAW + f", t AS (SELECT unnest({ROUGH_TABLES.format('context')}) AS name FROM raw) SELECT count(DISTINCT name) AS unique_tables_count FROM t",
)
def distinct_tables(spark, sf_dir):
    return profile.distinct_table_count(raw_samples(spark, sf_dir))


@query(
    "profile_keyword_histogram",
    RAW + f""", k AS (SELECT unnest({Q.listed(TRACKED_KEYWORDS)}) AS keyword)
SELECT keyword, count(*) AS samples FROM raw JOIN k ON contains(upper(answer), keyword)
GROUP BY keyword ORDER BY samples DESC, keyword LIMIT 10""",
)
def keyword_histogram(spark, sf_dir):
    return profile.keyword_histogram(raw_samples(spark, sf_dir))


@query(
    "profile_complexity",
    PREP + """SELECT split, l.complexity, count(p.sample_id) AS samples,
  round(100.0 * count(p.sample_id) / sum(count(p.sample_id)) OVER (PARTITION BY split), 6)::DOUBLE AS pct
FROM (SELECT * FROM (VALUES ('simple'), ('medium'), ('complex')) v(complexity), (SELECT DISTINCT split FROM prepped)) l
LEFT JOIN prepped p USING (split, complexity) GROUP BY split, l.complexity""",
)
def complexity_distribution(spark, sf_dir):
    return rounded(profile.complexity_distribution(processed(spark, sf_dir), ("split",)))


@query("profile_observed_levels", PREP + "SELECT complexity, count(*) AS samples FROM kept GROUP BY 1 ORDER BY 1")
def observed(spark, sf_dir):
    return profile.observed_distribution(kept(spark, sf_dir))


@query(
    "profile_keyword_frequency",
    PREP + """, k AS (SELECT unnest(kws) AS keyword FROM kept)
SELECT keyword, count(*) AS samples, round(100.0 * count(*) / (SELECT count(*) FROM kept), 6)::DOUBLE AS pct
FROM k GROUP BY 1 ORDER BY samples DESC, keyword LIMIT 15""",
)
def keyword_frequency(spark, sf_dir):
    return rounded(profile.keyword_frequency(kept(spark, sf_dir)))


def _length_row(c: str) -> str:
    shown = c != "schema_length"
    ps = ", ".join(
        (f"round(quantile_cont({c}, {p / 100}), 6)" if shown else "NULL") + f"::DOUBLE AS p{p}"
        for p in profile.PERCENTILES
    )
    return (
        f"SELECT '{c}' AS field, round(avg({c}), 6) AS mean, median({c})::DOUBLE AS median, min({c}) AS min,"
        f" max({c}) AS max, round(stddev_pop({c}), 6) AS std, {ps} FROM kept"
    )


@query("profile_lengths", PREP + " UNION ALL ".join(_length_row(c) for c in profile.LENGTHS))
def lengths(spark, sf_dir):
    return rounded(profile.length_profile(kept(spark, sf_dir)))


def _schema_row(field: str, expr: str) -> str:
    n = f"CAST(len({expr.format('schema')}) AS INTEGER)"
    return (
        f"SELECT '{field}' AS field, round(avg({n}), 6) AS mean, median({n})::DOUBLE AS median,"
        f" min({n}) AS min, max({n}) AS max FROM kept"
    )


@query(
    "profile_schemas",
    PREP + _schema_row("tables", ROUGH_TABLES) + " UNION ALL " + _schema_row("columns", ROUGH_COLUMNS),
)
def schemas(spark, sf_dir):
    return rounded(profile.schema_profile(kept(spark, sf_dir)))


@query(
    "profile_splits",
    PREP + """SELECT split, count(*) AS samples, count(*) FILTER (is_valid) AS valid_samples,
  round(100.0 * count(*) FILTER (is_valid) / count(*), 6)::DOUBLE AS valid_pct,
  round(avg(question_length), 6) AS avg_question_length, round(avg(sql_length), 6) AS avg_sql_length,
  round(avg(schema_length), 6) AS avg_schema_length FROM prepped GROUP BY split""",
)
def split_summary(spark, sf_dir):
    return rounded(profile.split_summary(processed(spark, sf_dir)))


@query(
    "profile_prepared_splits",
    PREP + """SELECT split, count(*) AS samples, count(*) FILTER (is_valid) AS valid_samples,
  round(100.0 * count(*) FILTER (is_valid) / count(*), 6)::DOUBLE AS valid_pct,
  round(avg(question_length), 6) AS avg_question_length, round(avg(sql_length), 6) AS avg_sql_length,
  round(avg(schema_length), 6) AS avg_schema_length FROM kept GROUP BY split""",
)
def prepared_splits(spark, sf_dir):
    return rounded(jobs.corpus_summary(raw_samples(spark, sf_dir)))


def _prompt_words() -> str:
    from checks.schema_prompt import _template_sql

    return Q.words(_template_sql("default", "question", "schema"))


@query(
    "profile_prompt_lengths",
    PREP + f""", n AS (SELECT {_prompt_words()} AS n FROM kept)
SELECT count(*) AS num_samples_checked, round(avg(n), 6) AS avg_token_length, median(n)::DOUBLE AS median_token_length,
  max(n) AS max_token_length, min(n) AS min_token_length, count(*) FILTER (n > 30) AS too_long_count,
  round(100.0 * count(*) FILTER (n > 30) / count(*), 6)::DOUBLE AS too_long_pct, 30 AS max_length_threshold FROM n""",
)
def prompt_lengths(spark, sf_dir):
    prompts = formatting.format_samples(kept(spark, sf_dir))
    return rounded(profile.token_length_profile(prompts, 30))


def _prompt_tokens() -> str:
    from checks.schema_prompt import _template_sql

    prompt = _template_sql("concise", "question", "schema")
    return f"len(regexp_extract_all({prompt}, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \\n]'))"


@query(
    "profile_prompt_tokens",
    PREP + f""", n AS (SELECT split, CAST({_prompt_tokens()} AS INTEGER) AS n FROM kept)
SELECT split, count(*) AS num_samples_checked, round(avg(n), 6) AS avg_token_length, median(n)::DOUBLE AS median_token_length,
  max(n) AS max_token_length, min(n) AS min_token_length, count(*) FILTER (n > 60) AS too_long_count,
  round(100.0 * count(*) FILTER (n > 60) / count(*), 6)::DOUBLE AS too_long_pct, 60 AS max_length_threshold
FROM n GROUP BY split""",
)
def prompt_tokens(spark, sf_dir):
    prompts = formatting.format_samples(kept(spark, sf_dir), PromptOptions(template="concise"))
    return rounded(
        profile.token_length_profile(prompts, 60, count_tokens=_count_tokens, by=("split",))
    )


def _count_tokens(text):
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \n]"))


def _report_sql() -> str:
    """One branch per section of the report."""
    rows: list[str] = []

    def add(section, item, metric, value, where="true"):
        rows.append(
            f"SELECT split, '{section}' AS section, '{item}' AS item, '{metric}' AS metric,"
            f" round(({value})::DOUBLE, 6) AS value FROM d GROUP BY split HAVING {where}"
        )

    for level in ("simple", "medium", "complex"):
        hit = f"count(*) FILTER (complexity = '{level}')"
        add("complexity", level, "samples", hit)
        add("complexity", level, "pct", f"100.0 * {hit} / count(*)")
    profiles = [("length", c, c) for c in profile.LENGTHS] + [
        ("schema", "tables", "n_tables"), ("schema", "columns", "n_columns"),
    ]
    for section, item, c in profiles:
        for metric, value in (("mean", f"avg({c})"), ("median", f"median({c})"), ("min", f"min({c})"), ("max", f"max({c})")):
            add(section, item, metric, value)
        if section == "length":
            add(section, item, "std", f"stddev_pop({c})")
        if item in ("question_length", "sql_length"):
            for p in profile.PERCENTILES:
                add(section, item, f"p{p}", f"quantile_cont({c}, {p / 100})")
    checks = {
        "invalid": "NOT is_valid", "empty_question": "trim(question) = ''", "empty_sql": "trim(sql) = ''",
        "empty_schema": "trim(schema) = ''", "short_question": "question_length < 3",
        "long_sql": "sql_length > 100",
    }
    for name, cond in checks.items():
        hit = f"count(*) FILTER ({cond})"
        add("quality", name, "samples", hit, f"{hit} > 0")
    add_tables = (
        "SELECT split, 'schema', 'tables', 'distinct', count(DISTINCT name)::DOUBLE FROM "
        f"(SELECT split, unnest({ROUGH_TABLES.format('schema')}) AS name FROM d) GROUP BY split"
    )
    words = """SELECT split, 'keyword', keyword, 'samples', samples::DOUBLE FROM topk
UNION ALL SELECT split, 'keyword', keyword, 'pct', round(100.0 * samples / total, 6)::DOUBLE FROM topk"""
    ctes = f""", d AS (SELECT *, len({ROUGH_TABLES.format('schema')}) AS n_tables, len({ROUGH_COLUMNS.format('schema')}) AS n_columns FROM prepped),
kw AS (SELECT split, unnest(kws) AS keyword FROM d), kc AS (SELECT split, keyword, count(*) AS samples FROM kw GROUP BY 1, 2),
topk AS (SELECT kc.*, t.total FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY samples DESC, keyword) AS r FROM kc) kc
  JOIN (SELECT split, count(*) AS total FROM d GROUP BY 1) t USING (split))
"""
    return PREP + ctes + "\nUNION ALL ".join([*rows, add_tables, words])


@query("profile_report", _report_sql())
def report(spark, sf_dir):
    return rounded(profile.quality_report(stored(spark, sf_dir, processed)))


@query(
    "profile_merged_report",
    f"SELECT split, section, item, metric, value FROM ({_report_sql()}) AS r WHERE metric NOT IN ('median', 'distinct') AND NOT regexp_matches(metric, '^p[0-9]')",
)
def merged_report(spark, sf_dir):
    """The exact part of a report merged from the states of two halves that were stored apart."""
    samples = stored(spark, sf_dir, processed)
    states = [store(report_states.report_state(samples.where(half)), "state") for half in ("sample_id % 2 = 0", "sample_id % 2 = 1")]
    report = report_states.report_of(report_states.merge_states(states[0].unionByName(states[1])))
    return rounded(report.where("metric NOT IN ('median', 'distinct') AND NOT metric RLIKE '^p[0-9]'"))
