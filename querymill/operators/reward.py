"""Scoring tables of model responses.

Extraction and rubric are the costly part. They run before any join, on the scan's partitions, so
a sample that owns a large share of the responses does not gather that work in one task. The
joins carry scores and short name lists instead of texts wherever the result allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.functions import rubric as R
from querymill.functions.ddl import known_tables, query_tables
from querymill.functions.extraction import add_extraction, parsed_response, valid_format
from querymill.functions.rubric import RubricOptions
from querymill.functions.text import computed_once, or_empty
from querymill.operators.columns import percent
from querymill.operators.pairing import unbroadcast
from querymill.operators.sampling import top_n_per_group
from querymill.storage import store
from querymill.stored import Keyed, join_keyed, store_bucketed


def add_scores(
    df: DataFrame, response: str = "response", opts: RubricOptions = RubricOptions()
) -> DataFrame:
    """Add ``extracted_sql, syntax, syntax_valid, keywords, format, total`` to every response."""
    sql = F.col("extracted_sql")
    df = add_extraction(df, response, opts.parser)
    df = df.withColumn("__up", F.upper(or_empty(sql)))
    df = df.withColumns(
        {
            "__found": R.keyword_count(F.col("__up"), opts.keywords),
            "syntax_valid": R.syntax_valid(sql, opts),
        }
    )
    df = df.withColumns(
        {
            "syntax": R.syntax_score(sql, F.col("syntax_valid")),
            "keywords": R.keyword_score(F.col("__up"), F.col("__found")),
            "format": R.format_score(F.col(response), sql, F.col("__up"), opts.parser),
        }
    )
    total = R.total_score(
        sql, F.col("syntax"), F.col("syntax_valid"), F.col("keywords"), F.col("format"), opts
    )
    return df.withColumn("total", computed_once(total)).drop("__up", "__found")


def score_details(
    df: DataFrame, response: str = "response", opts: RubricOptions = RubricOptions()
) -> DataFrame:
    """Score breakdown with the weights. Strict mode does not act here."""
    relaxed = RubricOptions(
        opts.keywords, opts.syntax_weight, opts.keyword_weight, opts.format_weight, False,
        opts.normalize_sql, opts.parser,
    )
    weights = F.struct(
        F.lit(opts.syntax_weight).alias("syntax"),
        F.lit(opts.keyword_weight).alias("keywords"),
        F.lit(opts.format_weight).alias("format"),
    )
    return add_scores(df, response, relaxed).withColumn("weights", weights)


def score_metadata(
    responses: DataFrame,
    references: DataFrame | None = None,
    response: str = "response",
    opts: RubricOptions = RubricOptions(),
) -> DataFrame:
    """Breakdown per response plus its reference when there is one (left join on sample_id).

    A response without SQL reports a format of 0.
    """
    scored = score_details(responses, response, opts).withColumn(
        "format", F.when(F.col("extracted_sql").isNull(), 0.0).otherwise(F.col("format"))
    )
    if references is None:
        return scored
    return scored.join(
        unbroadcast(references.select("sample_id", "reference")), "sample_id", "left"
    )


def score_distinct(
    df: DataFrame, response: str = "response", opts: RubricOptions = RubricOptions()
) -> DataFrame:
    """Score every distinct text once and join the scores back.

    Pays off when texts repeat a lot. Repeats of a hot text are gone after the map-side part of the
    deduplication; the join back goes by a 128-bit digest, so long texts are shuffled only there,
    and AQE splits the partition of a hot digest.
    """
    text = or_empty(F.col(response))
    keyed = df.withColumn("__digest", F.md5(text))
    texts = keyed.select("__digest", text.alias(response)).distinct()
    scores = add_scores(texts, response, opts).drop(response)
    return keyed.join(unbroadcast(scores), "__digest", "left").drop("__digest")


def schema_dictionary(samples: DataFrame, context: str = "context") -> DataFrame:
    """``__digest, __tables``: known table names, read once for every distinct schema text.

    Repeats of a text are gone after the map-side part of the grouping, which goes by a 128-bit digest.
    """
    text = or_empty(F.col(context))
    keyed = samples.select(F.md5(text).alias("__digest"), text.alias("__text"))
    texts = keyed.dropDuplicates(["__digest"])
    return texts.select("__digest", known_tables(F.col("__text")).alias("__tables"))


def schema_lists(samples: DataFrame, context: str = "context") -> DataFrame:
    """``sample_id, __tables``: known table names per sample, by way of the dictionary.

    The join carries digests and name lists, no schema texts. The dictionary is stored, so that both
    sides are plain shuffles and AQE splits a digest that many samples share.
    """
    keyed = samples.select("sample_id", F.md5(or_empty(F.col(context))).alias("__digest"))
    listed = keyed.join(unbroadcast(store(schema_dictionary(samples, context), "schemas")), "__digest", "left")
    return listed.select("sample_id", "__tables")


def store_schemas(samples: DataFrame, path: str, buckets: int, context: str = "context") -> DataFrame:
    """Lay the known tables of every sample out once, bucketed by ``sample_id``, for many scorings.

    Scoring against it parses no schema and shuffles the responses' side only.
    """
    return store_bucketed(schema_lists(samples, context), path, "sample_id", buckets)


def schema_penalty(sql: Column, names: Column, tables: Column) -> Column:
    """Factor for queries that touch none of the known tables; 1 without SQL or known tables."""
    judged = sql.isNotNull() & (F.coalesce(F.size(tables), F.lit(0)) > 0)
    known = F.coalesce(F.arrays_overlap(names, tables), F.lit(False))
    return F.when(judged & ~known, R.UNKNOWN_TABLE_FACTOR).otherwise(1.0)


def rewards(
    responses: DataFrame,
    samples: DataFrame | None = None,
    response: str = "response",
    context: str = "context",
    opts: RubricOptions = RubricOptions(),
    schemas: DataFrame | None = None,
) -> DataFrame:
    """Scores plus ``reward``: the total, reduced when the schema of the sample is not used.

    ``schemas`` takes the place of ``samples``: a table of ``store_schemas``. Without either the
    reward is the total.
    """
    scored = add_scores(responses, response, opts)
    if samples is None and schemas is None:
        return scored.withColumn("reward", F.col("total"))
    lists = schema_lists(samples, context) if schemas is None else schemas
    named = scored.withColumn("__names", query_tables(F.col("extracted_sql")))
    joined = named.join(unbroadcast(lists), "sample_id", "left")
    factor = schema_penalty(F.col("extracted_sql"), F.col("__names"), F.col("__tables"))
    reward = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("total") * factor))
    return joined.withColumn("reward", reward).drop("__names", "__tables")


def parse_responses(
    df: DataFrame, response: str = "response", opts: RubricOptions = RubricOptions()
) -> DataFrame:
    """Add ``parsed struct<sql, valid, metadata>``."""
    df = add_extraction(df, response, opts.parser, into="__sql")
    parsed = parsed_response(F.col(response), F.col("__sql"), opts.parser)
    return df.withColumn("parsed", parsed).drop("__sql")


def batch_statistics(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean, population deviation, extremes, median, component means and valid share.

    The median is exact. Its state holds distinct scores, and a rule-based score takes few values.
    """
    fmt = F.when(F.col("extracted_sql").isNull(), 0.0).otherwise(F.col("format"))
    valid = F.count_if("syntax_valid")
    return scored.groupBy(*by).agg(
        F.count("*").alias("count"),
        F.coalesce(F.avg("total"), F.lit(0.0)).alias("mean_score"),
        F.stddev_pop("total").alias("std_score"),
        F.min("total").alias("min_score"),
        F.max("total").alias("max_score"),
        F.median("total").alias("median_score"),
        F.avg("syntax").alias("mean_syntax"),
        F.avg("keywords").alias("mean_keywords"),
        F.avg(fmt).alias("mean_format"),
        valid.alias("valid_sql_count"),
        percent(valid, F.count("*")).alias("valid_sql_percentage"),
    )


def environment_metrics(
    rewarded: DataFrame, by: tuple[str, ...] = (), response: str = "response",
    opts: RubricOptions = RubricOptions(),
) -> DataFrame:
    """Valid and syntax-correct shares and reward range of the output of ``rewards``."""
    sql = F.col("extracted_sql")
    valid = sql.isNotNull() & valid_format(F.col(response), sql, opts.parser)
    everything = F.count("*")
    return rewarded.groupBy(*by).agg(
        percent(F.count_if(valid), everything).alias("valid_sql_pct"),
        F.coalesce(F.avg("reward"), F.lit(0.0)).alias("avg_reward"),
        percent(F.count_if("syntax_valid"), everything).alias("syntax_correct_pct"),
        everything.alias("num_samples"),
        F.coalesce(F.min("reward"), F.lit(0.0)).alias("min_reward"),
        F.coalesce(F.max("reward"), F.lit(0.0)).alias("max_reward"),
    )


def reward_range(rewarded: DataFrame, batch: str, reward: str = "reward") -> DataFrame:
    """Average, least and greatest reward per training batch."""
    return rewarded.groupBy(batch).agg(
        F.avg(reward).alias("avg_reward"),
        F.min(reward).alias("min_reward"),
        F.max(reward).alias("max_reward"),
    )


def relative_advantage(
    rewarded: DataFrame,
    group: tuple[str, ...] = ("sample_id", "model"),
    reward: str = "reward",
    epsilon: float = 1e-4,
) -> DataFrame:
    """Reward of a candidate relative to the other candidates of its prompt.

    A window would pull every group into one task. Instead the group moments are aggregated, with
    map-side combine, stored, and joined back: both join sides are then plain shuffles, which lets
    AQE split the partition of a group that holds a large share of the rows. ``rewarded`` is read
    twice, so pass a stored table (as ``plans.jobs.advantages`` does).
    """
    moments = rewarded.groupBy(*group).agg(
        F.avg(reward).alias("__mean"), F.stddev_samp(reward).alias("__deviation")
    )
    centred = F.col(reward) - F.col("__mean")
    scale = F.coalesce(F.col("__deviation"), F.lit(0.0)) + F.lit(epsilon)
    return (
        rewarded.join(unbroadcast(store(moments, "moments")), list(group))
        .withColumn("advantage", centred / scale)
        .drop("__mean", "__deviation")
    )


def keyed_rewards(responses: Keyed, schemas: DataFrame, opts: RubricOptions = RubricOptions()) -> Keyed:
    """``rewards`` of stored responses against stored schemas in as many buckets: no shuffle."""

    def score(joined: DataFrame) -> DataFrame:
        scored = add_scores(joined, "response", opts)
        sql = F.col("extracted_sql")
        reward = F.col("total") * schema_penalty(sql, query_tables(sql), F.col("__tables"))
        return scored.withColumn("reward", F.greatest(F.lit(0.0), F.least(F.lit(1.0), reward))).drop("__tables")

    return join_keyed(responses, schemas, "left").each(score)


def keyed_advantage(
    rewarded: Keyed, group: tuple[str, ...] = ("sample_id", "model"), reward: str = "reward", epsilon: float = 1e-4
) -> DataFrame:
    """``relative_advantage`` over a stored layout: a group of an ordinary key lies in one bucket.

    Ordinary groups are bounded, so a window takes them where they lie, without a shuffle. Hot
    samples, kept apart, go by stored moments as unstored rewards do.
    """
    own = Window.partitionBy(*group)
    scale = F.coalesce(F.stddev_samp(reward).over(own), F.lit(0.0)) + F.lit(epsilon)
    cold = rewarded.cold.withColumn("advantage", (F.col(reward) - F.avg(reward).over(own)) / scale)
    return cold.unionByName(relative_advantage(rewarded.hot, group, reward, epsilon)) if rewarded.hot_keys else cold


def step_evaluation(
    responses: DataFrame, eval_frequency: int, step: str = "step", response: str = "response",
    opts: RubricOptions = RubricOptions(),
) -> DataFrame:
    """Statistics of every ``eval_frequency``-th training step; other steps are not scored."""
    scored = add_scores(evaluated_steps(responses, eval_frequency, step), response, opts)
    sql = F.col("extracted_sql")
    valid = sql.isNotNull() & valid_format(F.col(response), sql, opts.parser)
    everything = F.count("*")
    return scored.groupBy(step).agg(
        percent(F.count_if(valid), everything).alias("valid_sql_pct"),
        F.avg("total").alias("avg_reward"),
        percent(F.count_if(F.col("syntax") > 0.5), everything).alias("syntax_correct_pct"),
        percent(F.count_if(F.col("keywords") > 0.5), everything).alias("keyword_present_pct"),
    )


def evaluated_steps(df: DataFrame, eval_frequency: int, step: str = "step") -> DataFrame:
    return df.where(F.col(step) % eval_frequency == 0)


def step_examples(
    responses: DataFrame, eval_frequency: int, n: int = 3, step: str = "step",
    response: str = "response", opts: RubricOptions = RubricOptions(),
) -> DataFrame:
    """First n samples of every evaluated step with generated text, reward and validity."""
    order = [c for c in ("sample_id", "model", "candidate") if c in responses.columns]
    chosen = top_n_per_group(evaluated_steps(responses, eval_frequency, step), [step], order, n)
    scored = add_scores(chosen, response, opts)
    sql = F.col("extracted_sql")
    valid = sql.isNotNull() & valid_format(F.col(response), sql, opts.parser)
    return scored.withColumn("valid", valid).withColumnRenamed("total", "reward").drop(
        "syntax", "syntax_valid", "keywords", "format", "extracted_sql"
    )
