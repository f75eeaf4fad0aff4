"""Extraction, rubric scores, rewards, advantages."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as Q
from checks.prep import new_path
from checks.registry import joined, query, rounded
from checks.views import GENERATIONS_CTE, generations, raw_samples
from querymill.functions import extraction as X
from querymill.functions import rubric as R
from querymill.operators import generate, reward
from querymill.operators.score_store import ScoreStore
from querymill.plans import jobs
from querymill.stored import store_keyed

KEYS = "sample_id, candidate"
GENS = Q.with_(GENERATIONS_CTE)
FOUND = Q.with_(Q.EXTRACTED)
SCORED = Q.with_(Q.SCORED)
REWARDED = Q.with_(Q.REWARDED)


def _gens(spark, sf_dir):
    return generations(spark, sf_dir)


def _step(name, fn):
    """One extraction step on the stripped response."""

    def run(spark, sf_dir):
        text = X.strip(F.coalesce(F.col("response"), F.lit("")))
        return _gens(spark, sf_dir).select("sample_id", "candidate", fn(text).alias(name))

    return run


query("extract_code_block", FOUND + f"SELECT {KEYS}, x1 AS block FROM found_2")(
    _step("block", X.from_code_block)
)
query("extract_inline_code", FOUND + f"SELECT {KEYS}, x2 AS span FROM found_2")(
    _step("span", X.from_inline_code)
)
query("extract_raw_sql", FOUND + f"SELECT {KEYS}, x3 AS raw_sql FROM found_2")(
    _step("raw_sql", X.from_raw_text)
)
query("extract_until_end", FOUND + f"SELECT {KEYS}, {Q.strip(Q.until_end('t'))} AS cut FROM found_1")(
    _step("cut", X.until_end)
)
query("extract_clean", FOUND + f"SELECT {KEYS}, {Q.clean_extracted('t')} AS cleaned FROM found_1")(
    _step("cleaned", X.clean_extracted)
)
query("extract_looks_like_sql", FOUND + f"SELECT {KEYS}, {Q.looks_like_sql('t')} AS hit FROM found_1")(
    _step("hit", X.looks_like_sql)
)


@query("extract_sql", FOUND + f"SELECT {KEYS}, x AS extracted_sql FROM found")
def extract_sql(spark, sf_dir):
    return X.add_extraction(_gens(spark, sf_dir)).select("sample_id", "candidate", "extracted_sql")


@query(
    "extract_from_conversations",
    Q.with_(Q.extraction("conversations", "text", "conv_id, turn"))
    + "SELECT conv_id, turn, x AS extracted_sql FROM found",
)
def extract_from_conversations(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return X.add_extraction(turns, "text").select("conv_id", "turn", "extracted_sql")


@query(
    "extract_from_documents",
    Q.with_(Q.extraction("documents", "text", "doc_id"), Q.scoring("found"))
    + "SELECT doc_id, x AS extracted_sql, round(total, 6) AS total FROM scored",
)
def extract_from_documents(spark, sf_dir):
    """Whole documents of up to 20,000 words as responses."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = reward.add_scores(documents, "text")
    return rounded(scored.select("doc_id", "extracted_sql", "total"))


@query(
    "extract_valid_format",
    FOUND + f"""SELECT {KEYS}, length(t) BETWEEN 10 AND 4096 AND coalesce(length(x), 0) >= 10 AS valid FROM found""",
)
def valid_format(spark, sf_dir):
    df = X.add_extraction(_gens(spark, sf_dir))
    valid = X.valid_format(F.col("response"), F.col("extracted_sql"))
    return df.select("sample_id", "candidate", valid.alias("valid"))


@query(
    "extract_parsed",
    SCORED + f"""SELECT {KEYS}, x AS sql, valid, CASE WHEN original = '' THEN 'Empty response'
  WHEN x IS NULL THEN 'Failed to extract SQL' END AS error,
  CASE WHEN x IS NOT NULL THEN original END AS original_response,
  CAST(coalesce(length(x), 0) AS INTEGER) AS extracted_length FROM scored""",
)
def parsed(spark, sf_dir):
    df = reward.parse_responses(_gens(spark, sf_dir))
    return df.select("sample_id", "candidate", "parsed.sql", "parsed.valid", "parsed.metadata.*").fillna(
        0, "extracted_length"
    )


@query("reward_syntax", SCORED + f"SELECT {KEYS}, syntax, syntax_valid FROM scored")
def syntax(spark, sf_dir):
    df = X.add_extraction(_gens(spark, sf_dir))
    valid = R.syntax_valid(F.col("extracted_sql"))
    return df.select(
        "sample_id", "candidate",
        R.syntax_score(F.col("extracted_sql"), valid).alias("syntax"),
        valid.alias("syntax_valid"),
    )


@query(
    "reward_keywords_found",
    SCORED + f"SELECT {KEYS}, array_to_string({Q.keyword_hits('up')}, '|') AS found FROM scored",
)
def keywords_found(spark, sf_dir):
    df = X.add_extraction(_gens(spark, sf_dir))
    up = F.upper(F.coalesce(F.col("extracted_sql"), F.lit("")))
    return df.select("sample_id", "candidate", joined(R.keywords_found(up)).alias("found"))


@query("reward_keyword_tier", SCORED + f"SELECT {KEYS}, keywords FROM scored")
def keyword_tier(spark, sf_dir):
    return reward.add_scores(_gens(spark, sf_dir)).select("sample_id", "candidate", "keywords")


@query("reward_format", SCORED + f"SELECT {KEYS}, round(format, 6) AS format FROM scored")
def format_score(spark, sf_dir):
    return rounded(
        reward.add_scores(_gens(spark, sf_dir)).select("sample_id", "candidate", "format")
    )


@query("reward_total", SCORED + f"SELECT {KEYS}, round(total, 6) AS total FROM scored")
def total(spark, sf_dir):
    return rounded(
        reward.add_scores(_gens(spark, sf_dir)).select("sample_id", "candidate", "total")
    )


@query(
    "reward_strict",
    Q.with_(Q.EXTRACTED + "," + Q.scoring("found", strict=True))
    + f"SELECT {KEYS}, round(total, 6) AS total FROM scored",
)
def strict(spark, sf_dir):
    opts = R.RubricOptions(strict_mode=True)
    scored = reward.add_scores(_gens(spark, sf_dir), opts=opts)
    return rounded(scored.select("sample_id", "candidate", "total"))


@query(
    "reward_details",
    SCORED + f"""SELECT {KEYS}, x AS extracted_sql, syntax, syntax_valid, keywords,
  round(CASE WHEN x IS NULL THEN 0 ELSE format END, 6)::DOUBLE AS format, round(total, 6) AS total,
  0.4::DOUBLE AS w_syntax, 0.3::DOUBLE AS w_keywords, 0.3::DOUBLE AS w_format, answer AS reference
FROM scored LEFT JOIN (SELECT sample_id, answer FROM raw) USING (sample_id)""",
)
def details(spark, sf_dir):
    references = raw_samples(spark, sf_dir).select("sample_id", F.col("answer").alias("reference"))
    df = reward.score_metadata(_gens(spark, sf_dir), references)
    return rounded(
        df.select(
            "sample_id", "candidate", "extracted_sql", "syntax", "syntax_valid", "keywords",
            "format", "total", "reference",
            F.col("weights.syntax").alias("w_syntax"),
            F.col("weights.keywords").alias("w_keywords"),
            F.col("weights.format").alias("w_format"),
        )
    )


@query("reward_distinct_texts", SCORED + f"SELECT {KEYS}, model, round(total, 6) AS total FROM scored")
def distinct_texts(spark, sf_dir):
    scored = reward.score_distinct(_gens(spark, sf_dir))
    return rounded(scored.select("sample_id", "candidate", "model", "total"))


@query(
    "reward_batch_statistics",
    SCORED + """SELECT model, count(*) AS count, round(avg(total), 6) AS mean_score,
  round(stddev_pop(total), 6) AS std_score, round(min(total), 6) AS min_score, round(max(total), 6) AS max_score,
  round(median(total), 6) AS median_score, round(avg(syntax), 6) AS mean_syntax,
  round(avg(keywords), 6) AS mean_keywords,
  round(avg(CASE WHEN x IS NULL THEN 0 ELSE format END), 6) AS mean_format,
  count(*) FILTER (syntax_valid) AS valid_sql_count,
  round(100.0 * count(*) FILTER (syntax_valid) / count(*), 6)::DOUBLE AS valid_sql_percentage
FROM scored GROUP BY model""",
)
def batch_statistics(spark, sf_dir):
    return rounded(reward.batch_statistics(reward.add_scores(_gens(spark, sf_dir)), ("model",)))


@query("reward_with_schema", REWARDED + f"SELECT {KEYS}, model, round(reward, 6) AS reward FROM rewarded")
def with_schema(spark, sf_dir):
    df = reward.rewards(_gens(spark, sf_dir), raw_samples(spark, sf_dir))
    return rounded(df.select("sample_id", "candidate", "model", "reward"))


@query(
    "reward_environment_metrics",
    REWARDED + """SELECT model, round(100.0 * count(*) FILTER (valid) / count(*), 6)::DOUBLE AS valid_sql_pct,
  round(avg(reward), 6) AS avg_reward,
  round(100.0 * count(*) FILTER (syntax_valid) / count(*), 6)::DOUBLE AS syntax_correct_pct,
  count(*) AS num_samples, round(min(reward), 6) AS min_reward, round(max(reward), 6) AS max_reward
FROM rewarded GROUP BY model""",
)
def environment_metrics(spark, sf_dir):
    df = reward.rewards(_gens(spark, sf_dir), raw_samples(spark, sf_dir))
    return rounded(reward.environment_metrics(df, ("model",)))


@query(
    "reward_per_batch",
    SCORED + """SELECT sample_id // 100 AS batch, round(avg(total), 9) AS avg_reward,
  round(min(total), 9) AS min_reward, round(max(total), 9) AS max_reward FROM scored GROUP BY 1""",
)
def per_batch(spark, sf_dir):
    df = reward.rewards(_gens(spark, sf_dir)).withColumn("batch", F.expr("sample_id div 100"))
    return rounded(reward.reward_range(df, "batch"), 9)


@query(
    "adv_relative",
    REWARDED + f"""SELECT {KEYS}, model, round((reward - avg(reward) OVER w)
    / (coalesce(stddev_samp(reward) OVER w, 0) + 1e-4), 4) AS advantage
FROM rewarded WINDOW w AS (PARTITION BY sample_id, model)""",
)
def advantages(spark, sf_dir):
    df = jobs.advantages(_gens(spark, sf_dir), raw_samples(spark, sf_dir))
    return rounded(df.select("sample_id", "candidate", "model", "advantage"), 4)


BUCKETS = 16


@query("reward_score_store", SCORED + f"SELECT {KEYS}, model, round(total, 6) AS total, round(format, 6) AS format FROM scored")
def score_store(spark, sf_dir):
    """Half of the responses are scored by an earlier run; the later one scores what is new."""
    responses, path = _gens(spark, sf_dir), new_path(spark, "scores")
    ScoreStore(spark, path, BUCKETS).add(responses.where("candidate < 2"))
    scored = ScoreStore(spark, path, BUCKETS).score(responses)
    return rounded(scored.select("sample_id", "candidate", "model", "total", "format"))


@query(
    "adv_stored_layout",
    REWARDED + f"""SELECT {KEYS}, model, round(reward, 6) AS reward, round((reward - avg(reward) OVER w)
    / (coalesce(stddev_samp(reward) OVER w, 0) + 1e-4), 4) AS advantage
FROM rewarded WINDOW w AS (PARTITION BY sample_id, model)""",
)
def stored_advantages(spark, sf_dir):
    """Responses and schemas are stored by sample; rewards and advantages are not shuffled."""
    responses = store_keyed(_gens(spark, sf_dir), new_path(spark, "responses"), "sample_id", BUCKETS)
    schemas = reward.store_schemas(raw_samples(spark, sf_dir), new_path(spark, "schemas"), BUCKETS)
    df = jobs.stored_advantages(responses, schemas, new_path(spark, "rewards"), BUCKETS)
    return df.select("sample_id", "candidate", "model", F.round("reward", 6).alias("reward"), F.round("advantage", 4).alias("advantage"))


def with_steps(spark, sf_dir):
    """Candidates stand for training steps 50, 100, 150 and 200."""
    step = (F.col("candidate") + 1) * 50
    return _gens(spark, sf_dir).withColumn("step", step)


@query(
    "reward_step_evaluation",
    SCORED + """SELECT (candidate + 1) * 50 AS step,
  round(100.0 * count(*) FILTER (valid) / count(*), 6)::DOUBLE AS valid_sql_pct, round(avg(total), 6) AS avg_reward,
  round(100.0 * count(*) FILTER (syntax > 0.5) / count(*), 6)::DOUBLE AS syntax_correct_pct,
  round(100.0 * count(*) FILTER (keywords > 0.5) / count(*), 6)::DOUBLE AS keyword_present_pct
FROM scored WHERE ((candidate + 1) * 50) % 100 = 0 GROUP BY 1""",
)
def step_evaluation(spark, sf_dir):
    return rounded(reward.step_evaluation(with_steps(spark, sf_dir), 100))


@query(
    "reward_step_examples",
    SCORED + """, numbered AS (
  SELECT *, (candidate + 1) * 50 AS step, row_number() OVER (PARTITION BY candidate ORDER BY sample_id) AS r
  FROM scored WHERE ((candidate + 1) * 50) % 100 = 0)
SELECT step, sample_id, model, original AS response, round(total, 6) AS reward, valid FROM numbered WHERE r <= 3""",
)
def step_examples(spark, sf_dir):
    rows = reward.step_examples(with_steps(spark, sf_dir), 100, 3)
    return rounded(rows.select("step", "sample_id", "model", "response", "reward", "valid"))


_ECHO = "question || chr(10) || 'SQL:'"


@query(
    "generate_without_echo",
    Q.with_(GENERATIONS_CTE + f""", asked AS (
    SELECT sample_id, candidate, {_ECHO} AS prompt, response FROM gens JOIN (SELECT sample_id, question FROM raw) USING (sample_id))""")
    + f"SELECT {KEYS}, {Q.strip('response')} AS raw_output FROM asked",
)
def without_echo(spark, sf_dir):
    """Half of the answers repeat their prompt in front of the response."""
    questions = raw_samples(spark, sf_dir).select("sample_id", "question")
    df = _gens(spark, sf_dir).join(questions, "sample_id")
    prompt = F.concat("question", F.lit("\nSQL:"))
    generated = F.when(F.col("candidate") < 2, F.concat(prompt, "response")).otherwise(F.col("response"))
    return df.select(
        "sample_id", "candidate", generate.without_echo(generated, prompt).alias("raw_output")
    )


@query(
    "generate_until_stop",
    GENS + f"""SELECT {KEYS}, regexp_extract(response || 'Question: next' || chr(10) || chr(10) || 'x',
    '^(.*?)(?:\\n\\n|<\\|eot_id\\|>|Question:|Schema:|\\z)', 1, 's') AS cut FROM gens""",
)
def until_stop(spark, sf_dir):
    text = F.concat("response", F.lit("Question: next\n\nx"))
    return _gens(spark, sf_dir).select("sample_id", "candidate", generate.until_stop(text).alias("cut"))
