"""Pairing predictions with references by key, and checking that the pairing is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unbroadcast(df: DataFrame) -> DataFrame:
    """A join side whose size grows with the data and that Spark would misjudge.

    The size estimate of computed text and array columns goes by the compressed files they come
    from, which says little about the rows that a broadcast would copy to every executor. A merge
    join spills, and AQE splits its partitions when a key is hot.
    """
    return df.hint("merge")


def pair(
    predictions: DataFrame, references: DataFrame, key: str = "sample_id", how: str = "inner"
) -> DataFrame:
    """Equi-join of predictions with their references; ``how="left"`` keeps all predictions."""
    return predictions.join(unbroadcast(references), key, how)


def with_context(responses: DataFrame, samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """Attach ``reference`` and ``context`` of the sample to every response; null without a sample."""
    own = samples.select(key, F.col("answer").alias("reference"), "context")
    return pair(responses, own, key, "left")


def pairing_gaps(
    predictions: DataFrame, references: DataFrame, key: str = "sample_id"
) -> DataFrame:
    """One row: keys on only one side, and repeated keys among the references."""
    left = predictions.groupBy(key).agg(F.count("*").alias("__p"))
    right = references.groupBy(key).agg(F.count("*").alias("__r"))
    return left.join(right, key, "full").agg(
        F.count_if(F.col("__r").isNull()).alias("predictions_without_reference"),
        F.count_if(F.col("__p").isNull()).alias("references_without_prediction"),
        F.count_if(F.col("__r") > 1).alias("repeated_references"),
    )


def require_pairing(
    predictions: DataFrame, references: DataFrame, key: str = "sample_id"
) -> None:
    """Raise unless both sides hold the same keys and references are unique."""
    gaps = pairing_gaps(predictions, references, key).first().asDict()
    if any(gaps.values()):
        raise ValueError(f"Predictions and references do not match: {gaps}")
