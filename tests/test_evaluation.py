"""Lexing, pair metrics, aggregates, error analysis."""

import pytest
from pyspark.sql import functions as F

from querymill.functions import lexing, similarity
from querymill.operators import errors, evaluate, pairing
from querymill.sources import results as sink

PAIRS = [
    # predicted, reference
    ("select * from users where id=1", "SELECT * FROM users WHERE id = 1"),
    ("SELECT name FROM users", "SELECT id FROM users"),
    ("SELECT a FROM t", "SELECT a FROM t ORDER BY a"),
    ("", "SELECT a FROM t"),
    (None, "SELECT a FROM t"),
    ("SELECT a, a, b FROM t JOIN s ON a = b", "SELECT a, b FROM t JOIN s ON a = b"),
    ("SELECT COUNT( * ) FROM t WHERE a<=1 AND b<>'x  y'", "SELECT count(*) FROM T WHERE a <= 1 AND b <> 'x  y'"),
]


@pytest.fixture(scope="module")
def results(spark):
    preds = spark.createDataFrame(
        [(i, "m", p, bool(p)) for i, (p, _) in enumerate(PAIRS)],
        "sample_id long, model string, predicted_sql string, valid boolean",
    )
    refs = spark.createDataFrame(
        [(i, f"q{i}", r, "simple") for i, (_, r) in enumerate(PAIRS)],
        "sample_id long, question string, sql string, complexity string",
    )
    return evaluate.evaluate(preds, refs, strict=True).cache()


@pytest.fixture(scope="module")
def rows(results):
    return {r["sample_id"]: r for r in results.collect()}


def test_tokens(evaluate_expr):
    sql = "select u.a, 'it''s' from t left  join s on x>=-1 group by a -- end"
    (toks,) = evaluate_expr([sql], lexing.tokens)
    assert toks == [
        "SELECT", "U", ".", "A", ",", "'IT''S'", "FROM", "T", "LEFT  JOIN", "S", "ON", "X", ">=",
        "-1", "GROUP BY", "A", "-- END",
    ]


def test_exact_match_ignores_layout(rows):
    assert rows[0]["exact_match"] == 1.0 and rows[6]["exact_match"] == 1.0
    assert rows[1]["exact_match"] == 0.0
    assert rows[0]["token_accuracy"] == 1.0 and rows[0]["levenshtein"] == 0


def test_token_accuracy_counts_repeats(rows):
    assert rows[1]["token_accuracy"] == 0.75
    assert rows[5]["token_accuracy"] == 1.0


def test_keyword_scores(rows):
    # ORDER BY is missing; OR is no keyword here, AS and ON are not in either text.
    assert rows[2]["keyword_precision"] == 1.0 and rows[2]["keyword_recall"] == pytest.approx(2 / 3)
    assert rows[2]["keyword_f1"] == pytest.approx(0.8)


def test_missing_prediction_scores_zero(rows):
    for i in (3, 4):
        r = rows[i]
        assert r["predicted_sql"] == "" and not r["valid"]
        assert r["exact_match"] == r["token_accuracy"] == r["keyword_f1"] == r["structural_similarity"] == 0.0
        assert r["predicted_complexity"] == "invalid" and r["complexity_match"] == 0


def test_structure(spark):
    df = spark.createDataFrame([("SELECT a, SUM(b) FROM t JOIN s ON x = y LEFT JOIN r ON y = z",)], "s string")
    got = df.select(similarity.structure(F.upper("s"), lexing.tokens(F.col("s")))).first()[0]
    assert got["select_columns"] == ["A", " SUM(B)"]
    assert got["from_tables"] == ["T"] and got["join_tables"] == ["S"]
    assert got["aggregations"] == ["SUM"]


def test_complexity(spark):
    sql = "SELECT * FROM users JOIN orders ON users.id = orders.user_id"
    df = spark.createDataFrame([(sql,)], "s string")
    f = similarity.complexity_features(F.upper("s"), lexing.tokens(F.col("s")))
    row = df.select(f.alias("f")).select("f.*", similarity.complexity_score(F.col("f")).alias("score")).first()
    assert (row["num_tokens"], row["num_tables"], row["num_joins"]) == (14, 2, 1)
    # "OR" inside ORDERS counts three times as a condition.
    assert row["num_conditions"] == 2 and row["score"] == pytest.approx(1.4 + 10 + 10 + 6)
    assert not row["has_subquery"]


def test_bounds(results):
    bad = results.where(
        "exact_match = 1 AND token_accuracy < 1 OR token_accuracy NOT BETWEEN 0 AND 1"
        " OR structural_similarity NOT BETWEEN 0 AND 1 OR keyword_f1 NOT BETWEEN 0 AND 1"
    )
    assert bad.isEmpty()


def test_pairing_is_checked(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "sample_id long, predicted_sql string")
    right = spark.createDataFrame([(2, "q"), (2, "r"), (3, "s")], "sample_id long, sql string")
    gaps = pairing.pairing_gaps(left, right).first()
    assert tuple(gaps) == (1, 1, 1)
    with pytest.raises(ValueError):
        pairing.require_pairing(left, right)


def result_rows(spark, rows):
    schema = (
        "exact_match double, token_accuracy double, structural_similarity double, keyword_f1 double,"
        " keyword_precision double, keyword_recall double, valid boolean, complexity_match int,"
        " levenshtein int, reference_complexity string, paired boolean"
    )
    return spark.createDataFrame(rows, schema)


def test_aggregates(spark):
    one = (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, True, 1, 0, "simple", True)
    two = (0.0, 0.8, 0.9, 0.85, 0.9, 0.8, True, 1, 5, "simple", True)
    overall = evaluate.aggregate(result_rows(spark, [one, two])).first()
    assert overall["exact_match_rate"] == 50.0 and overall["valid_sql_rate"] == 100.0
    assert overall["avg_levenshtein"] == 2.5
    three = (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, True, 1, 0, "complex", True)
    levels = evaluate.aggregate_by_level(result_rows(spark, [one, one, three]))
    got = {r["reference_complexity"]: (r["count"], r["exact_match_rate"]) for r in levels.collect()}
    assert got == {"simple": (2, 100.0), "complex": (1, 100.0)}


def test_error_rates(results):
    row = errors.error_rate(results).first()
    assert (row["total"], row["total_errors"], row["invalid_errors"]) == (7, 5, 2)
    assert row["invalid_pct"] == 40.0
    assert errors.error_samples(results, 2).count() == 2
    none = errors.error_rate(results.where("exact_match = 1")).first()
    assert none["error_rate"] == 0.0 and none["invalid_pct"] == 0.0


def test_results_survive_csv_and_report(results, spark, tmp_path):
    path = str(tmp_path / "csv")
    sink.write_results_csv(results.drop("candidate"), path)
    schema = results.schema
    assert sorted(map(str, sink.read_results_csv(spark, path, schema).collect())) == sorted(
        map(str, results.collect())
    )
    text = sink.render_report(results)
    assert "exact_match_rate" in text and "simple\t" in text
    sink.write_summary_json(results, str(tmp_path / "json"))
    assert '"total_samples":7' in spark.read.text(str(tmp_path / "json")).first()[0]


def test_distances_can_be_left_out(spark):
    preds = spark.createDataFrame([(1, "SELECT 1", True)], "sample_id long, predicted_sql string, valid boolean")
    refs = spark.createDataFrame(
        [(1, "q", "SELECT 1", "simple")], "sample_id long, question string, sql string, complexity string"
    )
    out = evaluate.evaluate(preds, refs, levenshtein=False)
    assert "levenshtein" not in out.columns
    assert evaluate.aggregate(out).first()["exact_match_rate"] == 100.0


def test_predictions_without_reference_are_counted(spark):
    preds = spark.createDataFrame(
        [(1, "SELECT 1", True), (9, "SELECT 2", True)], "sample_id long, predicted_sql string, valid boolean"
    )
    refs = spark.createDataFrame(
        [(1, "q", "SELECT 1", "simple")], "sample_id long, question string, sql string, complexity string"
    )
    out = evaluate.evaluate(preds, refs)
    assert out.count() == 2 and out.where("paired").count() == 1
    row = evaluate.aggregate(out).first()
    assert (row["pairs"], row["unpaired"], row["exact_match_rate"], row["valid_sql_rate"]) == (1, 1, 100.0, 100.0)
    levels = {r["reference_complexity"]: r["count"] for r in evaluate.aggregate_all(out).collect()}
    assert levels["all"] == 2 and levels["unpaired"] == 1
    with pytest.raises(ValueError):
        evaluate.evaluate(preds, refs, strict=True)


def test_edit_distance_leaves_out_common_ends(spark):
    texts = ["", "a", "abc", "abd", "xabc", "ab ab ab", "ab ab", "aé😀b", "aé😁b", "b😀éa", "select a from t", "select a form t..."]
    long = "x" * 9000  # longer than the strides cover
    texts += [long + "ab" + long, long + "b" + long + "c"]
    pairs = [(a, b) for a in texts[:12] for b in texts[:12]] + [(texts[12], texts[13]), (texts[12], texts[12]), (None, "a")]
    df = spark.createDataFrame(pairs, "a string, b string").repartition(4)
    got = df.select("a", "b", similarity.edit_distance(F.col("a"), F.col("b")).alias("d"), F.levenshtein("a", "b").alias("e"))
    assert got.where("NOT (d <=> e)").count() == 0


def test_numbered_tokens_do_not_run_into_each_other(spark):
    toks = ["-- X#2", "-- X", "-- X", "2", "2", "3TOK", "23TOK", "TOK", "TOK"]
    df = spark.createDataFrame([(toks,)], "t array<string>")
    got = df.select(similarity.numbered(F.col("t"))).first()[0]
    assert len(set(got)) == len(toks) and {"-- X#2", " 1 -- X", " 1 2", " 1 TOK"} <= set(got)


def test_occurrences_do_not_overlap(evaluate_expr):
    from querymill.functions.text import occurrences

    assert evaluate_expr(["JOINJOIN JOI", "", None, "ééJOIN"], lambda t: occurrences(t, "JOIN")) == [2, 0, None, 1]
    assert evaluate_expr(["AAAAA"], lambda t: occurrences(t, "AA")) == [2]


def test_error_samples_store_only_their_columns(spark, results):
    samples = errors.error_samples(results, 2)
    assert len(samples.collect()) == 2
    stored = spark.read.parquet(*samples.inputFiles())
    assert not {"levenshtein", "keyword_f1", "predicted_complexity"} & set(stored.columns)


def test_pieces_hold_the_space_behind_them(evaluate_expr):
    given_ = ["select a from t", "count( a , b ) ,'x ,' )", "a  b"]
    sizes = evaluate_expr(given_, lambda c: F.size(F.regexp_extract_all(c, F.lit(lexing.SPACED_TOKEN), F.lit(0))))
    assert sizes[0] == 4
    assert evaluate_expr(given_, lexing.tidy_case) == ["SELECT a FROM t", "count(a, b),'x ,')", "a b"]


def test_distance_from_an_empty_text(spark):
    pairs = [("", "é\U0001f600b"), ("abc", ""), ("", ""), (None, "a"), ("a", None)]
    df = spark.createDataFrame(pairs, "p string, r string")
    got = df.select(similarity.edit_distance(F.col("p"), F.col("r")).alias("d")).collect()
    assert [r["d"] for r in got] == [3, 3, 0, None, None]


def test_predictions_are_shuffled_as_texts(spark):
    """Their features are computed behind the join, and only where there is a reference to compare with."""
    preds = spark.createDataFrame(
        [(1, "SELECT a FROM t", True), (1, "select a, a from t where b = b", True), (1, "", True), (1, None, None),
         (2, "", True), (2, "SELECT 1", True), (3, "SELECT 1", True), (None, "SELECT 1", True)],
        "sample_id long, predicted_sql string, valid boolean",
    )
    refs = spark.createDataFrame(
        [(1, "q", "SELECT a FROM t", "simple"), (2, "q", None, "simple"), (2, "q", "SELECT  1", None), (None, "q", "SELECT 1", "simple")],
        "sample_id long, question string, sql string, complexity string",
    )
    out = evaluate.evaluate(preds, refs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    above, _, left = plan.partition("SortMergeJoin")[2].partition("Exchange hashpartitioning(sample_id")
    assert "regexp_extract_all" not in left.partition("Exchange hashpartitioning(sample_id")[0]
    got = {(r["sample_id"], r["predicted_sql"], r["reference_sql"]): r for r in out.collect()}
    assert len(got) == 9 and out.count() == 10  # the null prediction and the empty one come out alike
    same = got[1, "SELECT a FROM t", "SELECT a FROM t"]
    assert [same[c] for c in ("exact_match", "token_accuracy", "structural_similarity", "keyword_f1", "levenshtein")] == [1.0] * 4 + [0]
    longer = got[1, "select a, a from t where b = b", "SELECT a FROM t"]
    assert (longer["exact_match"], longer["token_accuracy"], longer["keyword_recall"], longer["levenshtein"]) == (0.0, 1.0, 1.0, 15)
    empty = got[2, "", None]
    assert (empty["exact_match"], empty["token_accuracy"], empty["predicted_complexity"], empty["levenshtein"]) == (1.0, 0.0, "invalid", 0)
    alone = [got[3, "SELECT 1", None], got[None, "SELECT 1", None]]
    assert not any(r["paired"] for r in alone) and {r["levenshtein"] for r in alone} == {None}


def test_followers_of_one_word_and_of_several(spark):
    lists = [["FROM"], ["FROM", "A"], ["A", "FROM"], ["FROM", "A", "FROM", "A", "FROM", "B"], ["FROM", "FROM"], [], None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "i int, t array<string>")
    got = [r[0] for r in df.orderBy("i").select(lexing.followers(F.col("t"), ["FROM"])).collect()]
    assert got == [[], ["A"], [], ["A", "B"], ["FROM"], [], None]
