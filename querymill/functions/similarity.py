"""Metrics of one query, and of a predicted query against its reference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querymill.functions.lexing import followers, table_references
from querymill.functions.text import bind, contains_any, found_words, occurrences, strip, word_mask

# Keywords compared between prediction and reference, tested as substrings.
PAIR_KEYWORDS = (
    "SELECT", "FROM", "WHERE", "JOIN", "LEFT", "RIGHT", "INNER", "OUTER", "ON", "GROUP BY",
    "HAVING", "ORDER BY", "LIMIT", "OFFSET", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP",
    "ALTER", "UNION", "INTERSECT", "EXCEPT", "DISTINCT", "AS",
)
# Aggregate function names.
AGGREGATES = ("SUM", "COUNT", "AVG", "MAX", "MIN")
# Scores from which a query counts as medium and as complex.
MEDIUM_FROM, COMPLEX_FROM = 20, 50


def token_overlap(predicted: Column, reference: Column) -> Column:
    """Share of reference tokens matched by the prediction, counting repeats.

    ``array_remove`` counts a token without a nested lambda, so the cost per distinct reference
    token is one pass over either list.
    """

    def times(toks: Column, token: Column) -> Column:
        return F.size(toks) - F.size(F.array_remove(toks, token))

    matched = F.aggregate(
        F.array_distinct(reference),
        F.lit(0),
        lambda acc, t: acc + F.least(times(predicted, t), times(reference, t)),
    )
    return F.when(F.size(reference) == 0, 0.0).otherwise(matched / F.size(reference))


def numbered(toks: Column) -> Column:
    """Tokens, and behind them their repeats with the count of equal ones before, so that no entry repeats.

    The number stands in front, between spaces: no token begins with one.
    """
    def entries(again: Column) -> Column:
        return F.transform(
            again, lambda t, i: F.concat(F.lit(" "), i - F.array_position(again, t) + 2, F.lit(" "), t)
        )

    again = bind(F.sort_array(toks), lambda s: F.filter(s, lambda t, i: F.get(s, i - 1) == t))
    once = F.array_distinct(toks)
    return F.when(F.size(once) == F.size(toks), toks).otherwise(F.concat(once, bind(again, entries)))


def numbered_overlap(predicted: Column, reference: Column) -> Column:
    """``token_overlap`` of numbered tokens: a hash intersection instead of nested passes."""
    matched = F.size(F.array_intersect(predicted, reference))
    return F.when(F.size(reference) == 0, 0.0).otherwise(matched / F.size(reference))


# Lengths by which a common start is felt for: together they cover 8,188 characters, in short texts
# 124. Up to three characters more are cheaper to compare than to look for.
_STRIDES = tuple(1 << k for k in range(12, 1, -1))
_SHORT = 128


def _past_common_start(texts: Column) -> Column:
    """Both texts of a pair, reversed, without the start they share (its first 8,188 characters)."""
    a, b = texts["a"], texts["b"]

    def same(n: Column, stride: Column) -> Column:
        return F.substring(a, n + 1, stride) == F.substring(b, n + 1, stride)

    short = F.least(F.octet_length(a), F.octet_length(b)) < _SHORT
    strides = F.when(short, F.array(*[F.lit(s) for s in _STRIDES if s < _SHORT])).otherwise(
        F.array(*[F.lit(s) for s in _STRIDES])
    )
    shared = F.aggregate(strides, F.lit(0), lambda n, s: n + F.when(same(n, s), s).otherwise(0))
    return bind(
        shared,
        lambda n: F.struct(
            F.reverse(F.substring(a, n + 1, F.length(a))).alias("a"),
            F.reverse(F.substring(b, n + 1, F.length(b))).alias("b"),
        ),
    )


def edit_distance(predicted: Column, reference: Column) -> Column:
    """Levenshtein distance. A common start or end does not count, so only what lies between is compared.

    From or to an empty text it is the length of the other.
    """
    pair = F.array(F.struct(predicted.alias("a"), reference.alias("b")))
    ends = F.transform(F.transform(pair, _past_common_start), _past_common_start)
    rest = F.transform(ends, lambda e: F.levenshtein(e["a"], e["b"]))
    return (
        F.when(predicted == reference, 0)
        .when(predicted == "", F.length(reference))
        .when(reference == "", F.length(predicted))
        .otherwise(F.get(rest, F.lit(0)))
    )


def select_columns(up: Column) -> Column:
    """Comma-separated pieces in front of the first FROM, without the word SELECT."""
    part = strip(F.replace(F.substring_index(up, "FROM", 1), F.lit("SELECT"), F.lit("")))
    return F.when(F.contains(up, F.lit("SELECT")), F.array_distinct(F.split(part, ","))).otherwise(
        F.array().cast("array<string>")
    )


def structure(up: Column, toks: Column) -> Column:
    """The four filled structure sets of a query (``up`` is its upper-cased text)."""
    return F.struct(
        select_columns(up).alias("select_columns"),
        followers(toks, ["FROM"]).alias("from_tables"),
        followers(toks, ["JOIN"]).alias("join_tables"),
        found_words(up, AGGREGATES).alias("aggregations"),
    )


STRUCTURE_SETS = ("select_columns", "from_tables", "join_tables", "aggregations")


def structure_similarity(predicted: Column, reference: Column) -> Column:
    """Mean Jaccard similarity over the sets that are not empty in the reference.

    The lists hold no value twice, so the size of a union follows from that of the intersection.
    """
    total, used = F.lit(0.0), F.lit(0)
    for name in STRUCTURE_SETS:
        p, r = predicted[name], reference[name]
        present = F.size(r) > 0
        both = F.size(F.array_intersect(p, r))
        ratio = both / (F.size(p) + F.size(r) - both)
        total = total + F.when(present, ratio).otherwise(0.0)
        used = used + present.cast("int")
    return F.when(used > 0, total / used).otherwise(0.0)


def pair_keywords(up: Column) -> Column:
    return found_words(up, PAIR_KEYWORDS)


def pair_keyword_mask(up: Column) -> Column:
    return word_mask(up, PAIR_KEYWORDS)


def keyword_precision(predicted: Column, reference: Column) -> Column:
    """Both sides are keyword masks."""
    both = F.bit_count(predicted.bitwiseAND(reference))
    return F.when((predicted == 0) | (reference == 0), 0.0).otherwise(both / F.bit_count(predicted))


def keyword_recall(predicted: Column, reference: Column) -> Column:
    both = F.bit_count(predicted.bitwiseAND(reference))
    return F.when(reference == 0, 0.0).otherwise(both / F.bit_count(reference))


def harmonic_mean(precision: Column, recall: Column) -> Column:
    total = precision + recall
    return F.when(total > 0, F.lit(2.0) * (precision * recall) / total).otherwise(0.0)


def complexity_features(up: Column, toks: Column) -> Column:
    """Counts and flags behind the numeric complexity."""
    after_from = F.position(F.lit("SELECT"), up, F.instr(up, "FROM")) > 0
    conditions = occurrences(up, "WHERE") + occurrences(up, "AND") + occurrences(up, "OR")
    return F.struct(
        F.size(toks).alias("num_tokens"),
        table_references(toks).alias("num_tables"),
        occurrences(up, "JOIN").alias("num_joins"),
        (F.contains(up, F.lit("FROM")) & after_from).alias("has_subquery"),
        contains_any(up, AGGREGATES).alias("has_aggregation"),
        F.contains(up, F.lit("GROUP BY")).alias("has_group_by"),
        F.contains(up, F.lit("ORDER BY")).alias("has_order_by"),
        F.contains(up, F.lit("HAVING")).alias("has_having"),
        conditions.alias("num_conditions"),
    )


def complexity_score(features: Column) -> Column:
    def points(flag: str, worth: int) -> Column:
        return F.when(features[flag], worth).otherwise(0)

    return (
        features["num_tokens"] * F.lit(0.1)
        + features["num_tables"] * 5
        + features["num_joins"] * 10
        + points("has_subquery", 20)
        + points("has_aggregation", 10)
        + points("has_group_by", 10)
        + features["num_conditions"] * 3
    )


def score_level(score: Column, empty: Column) -> Column:
    """Level of a numeric complexity; an empty query is ``invalid``."""
    return (
        F.when(empty, "invalid")
        .when(score < MEDIUM_FROM, "simple")
        .when(score < COMPLEX_FROM, "medium")
        .otherwise("complex")
    )
