"""Pair metrics, joins, evaluation, error analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as Q
from checks.prep import RAW, kept, new_path
from checks.registry import joined, query, rounded
from checks.reward import FOUND, GENS
from checks.views import generations, raw_samples
from querymill.functions import lexing, similarity
from querymill.operators import errors, evaluate, pairing, reward
from querymill.operators.prepare import evaluation_view
from querymill.plans import jobs
from querymill.schemas import RESULT
from querymill.sources import results as sink

EVAL = Q.with_(Q.EVALUATED)
KEYS = ("sample_id", "candidate", "model")
RATES = (
    "exact_match", "token_accuracy", "structural_similarity", "keyword_precision",
    "keyword_recall", "keyword_f1",
)
_RATE_SQL = ", ".join(f"round({r}, 6) AS {r}" for r in RATES)


def result_table(spark, sf_dir):
    predictions = evaluate.predictions_from_responses(generations(spark, sf_dir))
    return evaluate.evaluate(predictions, evaluation_view(kept(spark, sf_dir)))


def _pair(*columns):
    return lambda spark, sf_dir: rounded(result_table(spark, sf_dir).where("paired").select(*KEYS, *columns))


def _feat(extra: str) -> str:
    return Q.with_(Q.RAW_CTE + "," + Q.features("raw", "answer", "f")) + extra


query("metric_comparable", _feat("SELECT sample_id, norm FROM f"))(
    lambda spark, sf_dir: raw_samples(spark, sf_dir).select(
        "sample_id", lexing.comparable(F.col("answer")).alias("norm")
    )
)
query("metric_exact_match", EVAL + "SELECT sample_id, candidate, model, exact_match FROM results WHERE paired")(
    _pair("exact_match")
)
query(
    "metric_token_accuracy",
    EVAL + "SELECT sample_id, candidate, model, round(token_accuracy, 6) AS token_accuracy FROM results WHERE paired",
)(_pair("token_accuracy"))
query(
    "metric_structure_similarity",
    EVAL + "SELECT sample_id, candidate, model, round(structural_similarity, 6) AS structural_similarity FROM results WHERE paired",
)(_pair("structural_similarity"))
query(
    "metric_keyword_f1",
    EVAL + """SELECT sample_id, candidate, model, round(keyword_precision, 6) AS keyword_precision,
  round(keyword_recall, 6) AS keyword_recall, round(keyword_f1, 6) AS keyword_f1 FROM results WHERE paired""",
)(_pair("keyword_precision", "keyword_recall", "keyword_f1"))
query("metric_levenshtein", EVAL + "SELECT sample_id, candidate, model, levenshtein FROM results WHERE paired")(
    _pair("levenshtein")
)
query(
    "metric_complexity_match",
    EVAL + "SELECT sample_id, candidate, model, predicted_complexity, reference_complexity, complexity_match FROM results WHERE paired",
)(_pair("predicted_complexity", "reference_complexity", "complexity_match"))


def _with_tokens(spark, sf_dir):
    raw = raw_samples(spark, sf_dir)
    return raw.withColumns({"up": F.upper("answer"), "toks": lexing.tokens(F.col("answer"))})


@query("metric_keywords", _feat("SELECT sample_id, array_to_string(pkws, '|') AS keywords FROM f"))
def pair_keywords(spark, sf_dir):
    return _with_tokens(spark, sf_dir).select(
        "sample_id", joined(similarity.pair_keywords(F.col("up"))).alias("keywords")
    )


def _sorted(x: str) -> str:
    return f"array_to_string(list_sort({x}), '|')"


@query(
    "metric_structure",
    _feat(f"SELECT sample_id, {', '.join(f'{_sorted(f's_{k}')} AS {k}_set' for k in ('select', 'from', 'join', 'agg'))} FROM f"),
)
def structure(spark, sf_dir):
    df = _with_tokens(spark, sf_dir).withColumn(
        "shape", similarity.structure(F.col("up"), F.col("toks"))
    )
    sets = zip(("select", "from", "join", "agg"), similarity.STRUCTURE_SETS)
    return df.select(
        "sample_id", *[joined(F.array_sort(F.col(f"shape.{s}"))).alias(f"{n}_set") for n, s in sets]
    )


@query(
    "metric_complexity",
    _feat("""SELECT sample_id, num_tokens, num_tables, num_joins, has_subquery, has_aggregation, has_group_by,
  has_order_by, has_having, num_conditions, round(score, 6)::DOUBLE AS score, lvl AS level FROM f"""),
)
def complexity(spark, sf_dir):
    df = _with_tokens(spark, sf_dir).withColumn(
        "f", similarity.complexity_features(F.col("up"), F.col("toks"))
    )
    score = similarity.complexity_score(F.col("f"))
    return rounded(
        df.select(
            "sample_id", "f.*", score.alias("score"),
            similarity.score_level(score, F.trim("up") == "").alias("level"),
        )
    )


@query("metric_table_references", _feat("SELECT sample_id, num_tables FROM f"))
def table_references(spark, sf_dir):
    return _with_tokens(spark, sf_dir).select(
        "sample_id", lexing.table_references(F.col("toks")).alias("num_tables")
    )


@query("metric_light_normal_form", RAW + f"SELECT sample_id, {Q.tidy('answer', False)} AS norm FROM raw")
def light_normal_form(spark, sf_dir):
    return raw_samples(spark, sf_dir).select(
        "sample_id", lexing.tidy_case(F.col("answer"), lower_names=False).alias("norm")
    )


@query(
    "join_prediction_reference",
    FOUND + "SELECT sample_id, candidate, x AS predicted_sql, answer FROM found JOIN (SELECT sample_id, answer FROM raw) USING (sample_id)",
)
def pair_up(spark, sf_dir):
    predictions = evaluate.predictions_from_responses(generations(spark, sf_dir))
    references = raw_samples(spark, sf_dir).select("sample_id", "answer")
    return pairing.pair(predictions, references).select(
        "sample_id", "candidate", "predicted_sql", "answer"
    )


@query(
    "join_pairing_gaps",
    EVAL + """, p AS (SELECT DISTINCT sample_id AS p FROM predicted), r AS (SELECT sample_id AS r, count(*) AS n FROM kept GROUP BY 1)
SELECT count(*) FILTER (r IS NULL) AS predictions_without_reference,
  count(*) FILTER (p IS NULL) AS references_without_prediction, count(*) FILTER (n > 1) AS repeated_references
FROM p FULL JOIN r ON p = r""",
)
def pairing_gaps(spark, sf_dir):
    return pairing.pairing_gaps(generations(spark, sf_dir), kept(spark, sf_dir))


@query(
    "join_response_context",
    GENS + """SELECT sample_id, candidate, response, answer AS reference, context
FROM gens LEFT JOIN (SELECT sample_id, answer, context FROM raw) USING (sample_id)""",
)
def response_context(spark, sf_dir):
    joined_ = pairing.with_context(generations(spark, sf_dir), raw_samples(spark, sf_dir))
    return joined_.select("sample_id", "candidate", "response", "reference", "context")


@query(
    "join_reference_if_present",
    GENS + """SELECT sample_id, candidate, reference FROM gens
LEFT JOIN (SELECT sample_id, answer AS reference FROM raw WHERE answer LIKE 'SELECT%') USING (sample_id)""",
)
def reference_if_present(spark, sf_dir):
    references = raw_samples(spark, sf_dir).where(F.startswith("answer", F.lit("SELECT")))
    scored = reward.score_metadata(
        generations(spark, sf_dir), references.select("sample_id", F.col("answer").alias("reference"))
    )
    return scored.select("sample_id", "candidate", "reference")


@query(
    "eval_per_sample",
    EVAL + f"""SELECT sample_id, candidate, model, question, predicted_sql, reference_sql, valid, complexity, paired,
  {_RATE_SQL}, predicted_complexity, reference_complexity, complexity_match, levenshtein FROM results WHERE paired""",
)
def per_sample(spark, sf_dir):
    return rounded(result_table(spark, sf_dir).where("paired"))


@query("eval_unpaired", EVAL + "SELECT sample_id, candidate, model, predicted_sql, valid FROM results WHERE NOT paired")
def unpaired(spark, sf_dir):
    """Predictions whose sample is not among the references."""
    return result_table(spark, sf_dir).where("NOT paired").select(*KEYS, "predicted_sql", "valid")


_MEANS = """count(*) FILTER (paired) AS pairs, count(*) FILTER (NOT paired) AS unpaired, round(100 * avg(exact_match), 6) AS exact_match_rate, round(100 * avg(token_accuracy), 6) AS avg_token_accuracy,
  round(100 * avg(structural_similarity), 6) AS avg_structural_similarity, round(100 * avg(keyword_f1), 6) AS avg_keyword_f1,
  round(100 * avg(keyword_precision), 6) AS avg_keyword_precision, round(100 * avg(keyword_recall), 6) AS avg_keyword_recall,
  round(100 * avg(valid::INT) FILTER (paired), 6) AS valid_sql_rate, round(100 * avg(complexity_match), 6) AS complexity_match_rate,
  round(avg(levenshtein), 6) AS avg_levenshtein"""


@query("eval_overall", EVAL + f"SELECT {_MEANS} FROM results")
def overall(spark, sf_dir):
    return rounded(evaluate.aggregate(result_table(spark, sf_dir)))


@query(
    "eval_by_level",
    EVAL + """SELECT reference_complexity, count(*) AS count, round(100 * avg(exact_match), 6) AS exact_match_rate,
  round(100 * avg(token_accuracy), 6) AS avg_token_accuracy,
  round(100 * avg(structural_similarity), 6) AS avg_structural_similarity,
  round(100 * avg(valid::INT), 6) AS valid_sql_rate FROM results
WHERE paired GROUP BY 1""",
)
def by_level(spark, sf_dir):
    return rounded(evaluate.aggregate_by_level(result_table(spark, sf_dir)))


@query(
    "eval_overall_and_levels",
    EVAL + f"""SELECT coalesce(level, 'all') AS reference_complexity, count(*) AS count, {_MEANS}
FROM (SELECT *, coalesce(reference_complexity, 'unpaired') AS level FROM results) GROUP BY GROUPING SETS ((), (level))""",
)
def overall_and_levels(spark, sf_dir):
    return rounded(evaluate.aggregate_all(result_table(spark, sf_dir)))


@query("eval_compare_models", EVAL + f"SELECT model, {_MEANS} FROM results GROUP BY model")
def compare_models(spark, sf_dir):
    return rounded(
        jobs.benchmark_models(generations(spark, sf_dir), kept(spark, sf_dir), levenshtein=True)
    )


_INFERENCE = Q.with_(
    Q.EXTRACTED
    + ", firsts AS (SELECT sample_id, candidate, model, x AS sql, t AS t0 FROM found),"
    + Q.extraction("firsts", "sql", "sample_id, candidate, model, sql, t0", "again")
    + ","
    + Q.scoring("again", tiers=False)
)


@query(
    "eval_inference_summary",
    _INFERENCE + f"""SELECT model, count(*) AS total_samples, count(answer) AS with_reference,
  round(100.0 * count(*) FILTER (sql IS NOT NULL AND length(t0) BETWEEN 10 AND 4096 AND length(sql) >= 10) / count(*), 6)::DOUBLE AS valid_sql_pct,
  round(avg(total), 6) AS avg_reward, round(min(total), 6) AS min_reward, round(max(total), 6) AS max_reward,
  round(100.0 * count(*) FILTER ({Q.tidy("coalesce(sql, '')", False)} = {Q.tidy('answer', False)}) / count(*), 6)::DOUBLE AS exact_match_pct
FROM scored JOIN (SELECT sample_id, answer FROM raw) USING (sample_id) GROUP BY model""",
)
def inference_summary(spark, sf_dir):
    references = raw_samples(spark, sf_dir).select("sample_id", F.col("answer").alias("sql"))
    return rounded(evaluate.inference_summary(generations(spark, sf_dir), references, ("model",)))


@query(
    "eval_report_rows",
    EVAL + f""", table_ AS (SELECT coalesce(level, 'all') AS section, count(*)::DOUBLE AS count, {_MEANS}
  FROM (SELECT *, coalesce(reference_complexity, 'unpaired') AS level FROM results) GROUP BY GROUPING SETS ((), (level))),
long AS (UNPIVOT table_ ON COLUMNS(* EXCLUDE section) INTO NAME metric VALUE value)
SELECT section, metric, value FROM long WHERE section = 'all' OR section <> 'unpaired' AND metric IN ('count', 'exact_match_rate',
  'avg_token_accuracy', 'avg_structural_similarity', 'valid_sql_rate')""",
)
def report_rows(spark, sf_dir):
    return rounded(evaluate.report_rows(result_table(spark, sf_dir)))


@query(
    "sink_summary_json",
    EVAL + f"""SELECT (SELECT count(*) FROM results) AS total_samples, {_MEANS},
  (SELECT string_agg(lv || ':' || n, '|' ORDER BY lv) FROM
    (SELECT coalesce(reference_complexity, 'unpaired') AS lv, count(*) AS n FROM results GROUP BY 1)) AS levels FROM results""",
)
def summary_json(spark, sf_dir):
    path = new_path(spark, "summary")
    sink.write_summary_json(result_table(spark, sf_dir), path)
    level = F.transform("by_complexity", lambda e: F.concat(e["complexity"], F.lit(":"), e["count"]))
    document = spark.read.json(path)
    return rounded(document.select("total_samples", "aggregate.*", joined(level).alias("levels")))


@query(
    "sink_results_csv",
    EVAL + f"""SELECT sample_id, candidate, model, question, predicted_sql, reference_sql, valid, complexity, paired,
  {_RATE_SQL}, predicted_complexity, reference_complexity, complexity_match, levenshtein FROM results WHERE paired""",
)
def results_csv(spark, sf_dir):
    table = result_table(spark, sf_dir).where("paired")
    path = new_path(spark, "results-csv")
    sink.write_results_csv(table, path)
    kept_fields = {f.name: f for f in RESULT.fields}
    schema = type(RESULT)([kept_fields[c] for c in table.columns])
    return rounded(sink.read_results_csv(spark, path, schema))


@query("errors_set", EVAL + "SELECT sample_id, candidate, model, predicted_sql FROM results WHERE exact_match = 0")
def error_set(spark, sf_dir):
    return errors.error_set(result_table(spark, sf_dir)).select(*KEYS, "predicted_sql")


_ERRORS = "count(*) FILTER (exact_match = 0)"


@query(
    "errors_rate",
    EVAL + f"""SELECT count(exact_match) AS total, {_ERRORS} AS total_errors,
  round(100.0 * {_ERRORS} / count(exact_match), 6)::DOUBLE AS error_rate,
  count(*) FILTER (exact_match = 0 AND NOT valid) AS invalid_errors,
  round(100.0 * count(*) FILTER (exact_match = 0 AND NOT valid) / {_ERRORS}, 6)::DOUBLE AS invalid_pct FROM results""",
)
def error_rate(spark, sf_dir):
    return rounded(errors.error_rate(result_table(spark, sf_dir)))


@query(
    "errors_by_level",
    EVAL + f"""SELECT reference_complexity, {_ERRORS} AS total_errors, count(exact_match) AS total,
  round(100.0 * {_ERRORS} / count(exact_match), 6)::DOUBLE AS error_rate FROM results GROUP BY 1 HAVING {_ERRORS} > 0""",
)
def error_rate_by_level(spark, sf_dir):
    return rounded(errors.error_rate_by_level(result_table(spark, sf_dir)))


@query(
    "errors_invalid_share",
    EVAL + f"""SELECT model, count(*) FILTER (exact_match = 0 AND NOT valid) AS invalid_errors,
  round(100.0 * count(*) FILTER (exact_match = 0 AND NOT valid) / {_ERRORS}, 6)::DOUBLE AS invalid_pct
FROM results GROUP BY model""",
)
def invalid_share(spark, sf_dir):
    rates = errors.error_rate(result_table(spark, sf_dir), ("model",))
    return rounded(rates.select("model", "invalid_errors", "invalid_pct"))


@query(
    "errors_samples",
    EVAL + """SELECT question, reference_sql, predicted_sql, valid, round(token_accuracy, 6) AS token_accuracy,
  round(structural_similarity, 6) AS structural_similarity, reference_complexity FROM results
WHERE exact_match = 0 ORDER BY sample_id, candidate LIMIT 20""",
)
def error_samples(spark, sf_dir):
    return rounded(
        errors.error_samples(result_table(spark, sf_dir), 20, ("sample_id", "candidate"))
    )
