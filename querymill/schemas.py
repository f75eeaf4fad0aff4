"""Explicit schemas of the tables that are read and written."""

from __future__ import annotations

from pyspark.sql import types as T

RAW = T.StructType(
    [
        T.StructField("sample_id", T.LongType()),
        T.StructField("question", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("answer", T.StringType()),
    ]
)
RESPONSE = T.StructType(
    [
        T.StructField("sample_id", T.LongType()),
        T.StructField("candidate", T.IntegerType()),
        T.StructField("model", T.StringType()),
        T.StructField("response", T.StringType()),
    ]
)
PROCESSED = T.StructType(
    [
        T.StructField("sample_id", T.LongType()),
        T.StructField("question", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("schema", T.StringType()),
        T.StructField("sql", T.StringType()),
        T.StructField("question_length", T.IntegerType()),
        T.StructField("schema_length", T.IntegerType()),
        T.StructField("sql_length", T.IntegerType()),
        T.StructField("is_valid", T.BooleanType()),
        T.StructField("validation_error", T.StringType()),
        T.StructField("sql_keywords", T.ArrayType(T.StringType())),
        T.StructField("complexity", T.StringType()),
        T.StructField("split", T.StringType()),
    ]
)
RESULT = T.StructType(
    [
        T.StructField("sample_id", T.LongType()),
        T.StructField("candidate", T.IntegerType()),
        T.StructField("model", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("predicted_sql", T.StringType()),
        T.StructField("reference_sql", T.StringType()),
        T.StructField("valid", T.BooleanType()),
        T.StructField("complexity", T.StringType()),
        T.StructField("exact_match", T.DoubleType()),
        T.StructField("token_accuracy", T.DoubleType()),
        T.StructField("structural_similarity", T.DoubleType()),
        T.StructField("keyword_precision", T.DoubleType()),
        T.StructField("keyword_recall", T.DoubleType()),
        T.StructField("keyword_f1", T.DoubleType()),
        T.StructField("predicted_complexity", T.StringType()),
        T.StructField("reference_complexity", T.StringType()),
        T.StructField("complexity_match", T.IntegerType()),
        T.StructField("levenshtein", T.IntegerType()),
        T.StructField("paired", T.BooleanType()),
    ]
)
