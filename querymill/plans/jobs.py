"""The end-to-end jobs: prepare a corpus, score generations, benchmark models."""

from __future__ import annotations

from pyspark.sql import DataFrame

from querymill.functions.rubric import RubricOptions
from querymill.operators.evaluate import aggregate, evaluate, predictions_from_responses
from querymill.operators.prepare import (
    PrepareOptions,
    evaluation_view,
    filter_samples,
    preprocess,
)
from querymill.operators.profile import split_summary
from querymill.operators.reward import keyed_advantage, keyed_rewards, relative_advantage, rewards
from querymill.operators.sampling import ensure_splits
from querymill.storage import store
from querymill.stored import Keyed
from querymill.sources.corpus import write_processed


def prepare_corpus(
    raw: DataFrame,
    path: str | None = None,
    opts: PrepareOptions = PrepareOptions(),
    create_splits: bool = True,
    **sizes: float | str | None,
) -> DataFrame:
    """Split, preprocess, filter and optionally write; returns the processed samples.

    A stratified split needs the label that preprocessing adds, so it comes after it, over the
    samples that are kept, from a stored table.
    """
    stratify_by = sizes.pop("stratify_by", None)
    late = stratify_by is not None and stratify_by not in raw.columns
    early = raw if late else ensure_splits(raw, create_splits, stratify_by=stratify_by, **sizes)
    processed = preprocess(early, opts)
    if opts.filter_invalid:
        processed = filter_samples(processed, opts)
    if late:
        processed = ensure_splits(store(processed, "processed"), create_splits, stratify_by=stratify_by, **sizes)
    if path is None:
        return processed
    write_processed(processed, path)
    return processed.sparkSession.read.parquet(path)


def corpus_summary(raw: DataFrame, opts: PrepareOptions = PrepareOptions()) -> DataFrame:
    return split_summary(prepare_corpus(raw, opts=opts))


def advantages(
    responses: DataFrame, samples: DataFrame, opts: RubricOptions = RubricOptions()
) -> DataFrame:
    """Rewards of all candidates and their advantage within the prompt's group.

    Rewards are stored first, without texts: the group moments and the rows both read them.
    """
    scored = rewards(responses, samples, opts=opts)
    narrow = scored.select("sample_id", "model", "candidate", "total", "reward")
    return relative_advantage(store(narrow, "rewards"))


def stored_advantages(responses: Keyed, schemas: DataFrame, path: str, buckets: int, opts: RubricOptions = RubricOptions()) -> DataFrame:
    """``advantages`` of responses and schemas that are stored in as many buckets.

    From the responses to the advantages no row of an ordinary sample is shuffled: rewards are written
    into the buckets that the responses were read from.
    """
    columns = ("sample_id", "model", "candidate", "total", "reward")
    rewarded = keyed_rewards(responses, schemas, opts).each(lambda rows: rows.select(*columns))
    return keyed_advantage(rewarded.stored(path, buckets))


def benchmark_models(
    responses: DataFrame, processed: DataFrame, levenshtein: bool = False, strict: bool = False
) -> DataFrame:
    """One aggregate row per model, from one job over all models' responses."""
    predictions = predictions_from_responses(responses)
    results = evaluate(predictions, evaluation_view(processed), levenshtein, strict)
    return aggregate(results, ("model",))
