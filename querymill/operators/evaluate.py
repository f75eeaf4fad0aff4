"""Evaluating predicted queries against references, and summarising the results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.functions import similarity as S
from querymill.functions.extraction import add_extraction, valid_format
from querymill.functions.lexing import comparable, tidy_case, tokens
from querymill.functions.rubric import RubricOptions
from querymill.functions.text import computed_once, or_empty
from querymill.operators.columns import as_rows, percent
from querymill.operators.pairing import pair, require_pairing
from querymill.operators.reward import add_scores

# Result metric -> name of its mean in percent.
RATES = {
    "exact_match": "exact_match_rate",
    "token_accuracy": "avg_token_accuracy",
    "structural_similarity": "avg_structural_similarity",
    "keyword_f1": "avg_keyword_f1",
    "keyword_precision": "avg_keyword_precision",
    "keyword_recall": "avg_keyword_recall",
    "valid": "valid_sql_rate",
    "complexity_match": "complexity_match_rate",
}
_METRICS = (*[m for m in RATES if m != "valid"], "predicted_complexity", "reference_complexity")
LEVEL_RATES = ("exact_match", "token_accuracy", "structural_similarity", "valid")


def add_query_features(df: DataFrame, sql: str, prefix: str) -> DataFrame:
    """Add what the pair metrics need of one query: ``norm, mask, shape, tokens, level``.

    Tokens are numbered by occurrence, so that their overlap is a set intersection.
    """
    up, toks = f"{prefix}_up", f"{prefix}_list"
    df = df.withColumns(
        {up: F.upper(or_empty(F.col(sql))), toks: tokens(F.col(sql))}
    )
    score = S.complexity_score(S.complexity_features(F.col(up), F.col(toks)))
    df = df.withColumn(f"{prefix}_score", score)
    empty = F.size(toks) == 0  # every character but whitespace is part of a token
    return df.withColumns(
        {
            f"{prefix}_norm": computed_once(comparable(F.col(sql))),
            f"{prefix}_mask": S.pair_keyword_mask(F.col(up)),
            f"{prefix}_shape": S.structure(F.col(up), F.col(toks)),
            f"{prefix}_level": S.score_level(F.col(f"{prefix}_score"), empty),
            f"{prefix}_tokens": S.numbered(F.col(toks)),
        }
    ).drop(up, toks, f"{prefix}_score")


def _features_of(prefix: str) -> list[str]:
    return [f"{prefix}_{n}" for n in ("norm", "mask", "shape", "tokens", "level")]


def pair_metrics(paired: DataFrame) -> DataFrame:
    """Metric columns of rows that hold the ``pred`` and ``ref`` features of both queries."""
    p = {n.split("_")[1]: F.col(n) for n in _features_of("pred")}
    r = {n.split("_")[1]: F.col(n) for n in _features_of("ref")}
    with_rates = paired.withColumns(
        {
            "exact_match": (p["norm"] == r["norm"]).cast("double"),
            "token_accuracy": S.numbered_overlap(p["tokens"], r["tokens"]),
            "structural_similarity": S.structure_similarity(p["shape"], r["shape"]),
            "keyword_precision": S.keyword_precision(p["mask"], r["mask"]),
            "keyword_recall": S.keyword_recall(p["mask"], r["mask"]),
        }
    )
    return with_rates.withColumns(
        {
            "keyword_f1": S.harmonic_mean(F.col("keyword_precision"), F.col("keyword_recall")),
            "predicted_complexity": p["level"],
            "reference_complexity": r["level"],
            "complexity_match": (p["level"] == r["level"]).cast("int"),
        }
    )


def evaluate(
    predictions: DataFrame,
    references: DataFrame,
    levenshtein: bool = True,
    strict: bool = False,
) -> DataFrame:
    """Per-sample metric table.

    ``predictions``: sample_id, predicted_sql, valid and any further columns (model, candidate).
    ``references``: sample_id, question, sql, complexity. A null prediction counts as empty.

    A prediction without reference keeps its row, with ``paired`` false and null metrics; with
    ``strict`` the two sides must hold the same keys. The distance compares every character with
    every other; leave it out where queries are long and the rates suffice. The features of a
    reference are computed once, in front of the join. Those of a prediction, of which there are
    several per reference, are computed behind it: only the text is shuffled and sorted, a
    prediction without reference needs none, and one that is its reference letter by letter has
    the reference's.
    """
    if strict:
        require_pairing(predictions, references)
    refs = references.select(
        "sample_id", "question", F.col("sql").alias("reference_sql"), "complexity"
    )
    refs = add_query_features(refs, "reference_sql", "ref")
    preds = predictions.withColumns(
        {
            "predicted_sql": or_empty(F.col("predicted_sql")),
            "valid": F.coalesce(F.col("valid"), F.lit(False)),
        }
    )
    joined = pair(preds, refs.withColumn("paired", F.lit(True)), how="left")
    joined = joined.withColumn("paired", F.coalesce("paired", F.lit(False)))
    verbatim = F.col("predicted_sql") == or_empty(F.col("reference_sql"))
    joined = joined.withColumn("__sql", F.when(F.col("paired") & ~verbatim, F.col("predicted_sql")))
    joined = add_query_features(joined, "__sql", "pred").drop("__sql")
    own = zip(_features_of("pred"), _features_of("ref"))
    rated = pair_metrics(joined.withColumns({p: F.when(verbatim, F.col(r)).otherwise(F.col(p)) for p, r in own}))
    rated = rated.withColumns({c: F.when(F.col("paired"), F.col(c)) for c in _METRICS})
    norms = F.col("pred_norm"), F.col("ref_norm")
    if levenshtein:
        rated = rated.withColumn("levenshtein", S.edit_distance(*norms))
    return rated.drop(*_features_of("pred"), *_features_of("ref"))


def predictions_from_responses(
    responses: DataFrame, response: str = "response", opts: RubricOptions = RubricOptions()
) -> DataFrame:
    """Extracted SQL and its validity, in the shape ``evaluate`` takes."""
    df = add_extraction(responses, response, opts.parser, into="predicted_sql")
    sql = F.col("predicted_sql")
    valid = sql.isNotNull() & valid_format(F.col(response), sql, opts.parser)
    return df.withColumn("valid", valid).drop(response)


def _rate(metric: str) -> Column:
    return (F.avg(F.when(F.col("paired"), F.col(metric).cast("double"))) * 100).alias(RATES[metric])


def _means(results: DataFrame) -> list[Column]:
    """Pairs, predictions without reference, and means over the pairs."""
    paired = F.count_if("paired")
    out = [paired.alias("pairs"), (F.count("*") - paired).alias("unpaired"), *[_rate(m) for m in RATES]]
    if "levenshtein" in results.columns:
        out.append(F.avg("levenshtein").alias("avg_levenshtein"))
    return out


def aggregate(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of every metric; ``by=("model",)`` compares checkpoints in one job."""
    return results.groupBy(*by).agg(*_means(results))


def aggregate_by_level(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count and four rates per complexity level of the reference query; counts add up to the pairs."""
    return (
        results.where("paired")
        .groupBy(*by, "reference_complexity")
        .agg(F.count("*").alias("count"), *[_rate(m) for m in LEVEL_RATES])
    )


def aggregate_all(results: DataFrame) -> DataFrame:
    """Overall row (``all``) and one row per level in a single pass over the results.

    Predictions without reference make up the row ``unpaired``, which has no rates.
    """
    metrics = [*RATES, *[c for c in ("levenshtein",) if c in results.columns]]
    level = F.col("reference_complexity")
    narrow = results.select(F.when(F.col("paired"), level).otherwise("unpaired").alias("reference_complexity"), "paired", *metrics)
    grouped = narrow.groupingSets([[], [level]], level).agg(
        F.grouping("reference_complexity").alias("__overall"),
        F.count("*").alias("count"),
        *_means(narrow),
    )
    label = F.when(F.col("__overall") == 1, F.lit("all")).otherwise(level)
    return grouped.withColumn("reference_complexity", label).drop("__overall")


def inference_summary(
    responses: DataFrame,
    references: DataFrame,
    by: Sequence[str] = (),
    response: str = "response",
) -> DataFrame:
    """Valid share, reward range, rows with a reference and the share of these that match it.

    The extracted SQL is scored again as a response of its own, with an empty keyword list.
    """
    preds = predictions_from_responses(responses, response)
    scored = add_scores(preds, "predicted_sql", RubricOptions(keywords=()))
    refs = references.select(
        "sample_id", tidy_case(F.col("sql"), lower_names=False).alias("__ref"), F.col("sql").isNull().alias("__no_ref")
    )
    paired = pair(scored, refs, how="left").withColumn(
        "__same", tidy_case(F.col("predicted_sql"), lower_names=False) == F.col("__ref")
    )
    everything = F.count("*")
    return paired.groupBy(*by).agg(
        everything.alias("total_samples"),
        F.count_if(F.col("__no_ref") == F.lit(False)).alias("with_reference"),
        percent(F.count_if("valid"), everything).alias("valid_sql_pct"),
        F.avg("total").alias("avg_reward"),
        F.min("total").alias("min_reward"),
        F.max("total").alias("max_reward"),
        percent(F.count_if("__same"), F.count_if(F.col("__no_ref") == F.lit(False))).alias("exact_match_pct"),
    )


def report_rows(results: DataFrame) -> DataFrame:
    """``section, metric, value`` rows of a report: overall rates, then rates per level."""
    table = aggregate_all(results)
    names = [c for c in table.columns if c not in ("reference_complexity", "count")]
    entries = [((n,), F.col(n).cast("double")) for n in names]
    entries.append((("count",), F.col("count").cast("double")))
    rows = as_rows(table, ("reference_complexity",), entries, ("metric", "value"))
    level_metrics = [RATES[m] for m in LEVEL_RATES] + ["count"]
    section = F.col("reference_complexity")
    wanted = (section == "all") | ((section != "unpaired") & F.col("metric").isin(*level_metrics))
    return rows.where(wanted & F.col("value").isNotNull()).select(section.alias("section"), "metric", "value")
