"""Extraction and rubric against known values."""

import pytest

from querymill.functions import extraction as X
from querymill.functions.rubric import RubricOptions
from querymill.operators import reward

GOLDEN = [
    ("SELECT * FROM users WHERE id = 1", 1.0, 0.75, 1.0, 0.925),
    ("SELECT * FROM users", 1.0, 0.6, 1.0, 0.88),
    ("SELECT * FORM users", 0.15, 0.5, 0.925, 0.4875),
    ("SELECT FORM users", 0.15, 0.5, 0.925, 0.4875),
    ("INSERT INTO products VALUES (1, 'test')", 1.0, 0.5, 1.0, 0.85),
    ("UPDATE users SET name = 'test'", 1.0, 0.5, 0.925, 0.8275),
    ("SELECT u.name FROM users u JOIN orders o ON u.id = o.user_id", 1.0, 0.75, 1.0, 0.925),
    ("SELECT * FROM users WHERE id = 1 ORDER BY name LIMIT 10", 1.0, 1.0, 1.0, 1.0),
    ("SELECT * FROM users; DROP TABLE users;", 1.0, 0.75, 1.0, 0.925),
    ("Here's some text with maybe SQL somewhere...", 1.0, 0.0, 0.75, 0.625),
    ("This is not SQL", 0.0, 0.0, 0.0, 0.0),
    ("Not SQL", 0.0, 0.0, 0.0, 0.0),
    ("", 0.0, 0.0, 0.0, 0.0),
    (None, 0.0, 0.0, 0.0, 0.0),
]


def scored(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "sample_id long, response string")
    return reward.add_scores(df, opts=RubricOptions(**options)).orderBy("sample_id").collect()


def extracted(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string")
    out = X.add_extraction(df, opts=X.ParserOptions(**options)).orderBy("i").collect()
    return [r["extracted_sql"] for r in out]


def test_golden_scores(spark):
    rows = scored(spark, [g[0] for g in GOLDEN])
    for row, (_, syntax, keywords, fmt, total) in zip(rows, GOLDEN):
        assert (row["syntax"], row["keywords"]) == (syntax, keywords), row
        assert row["format"] == pytest.approx(fmt) and row["total"] == pytest.approx(total), row


def test_strict_mode_and_custom_keywords(spark):
    (row,) = scored(spark, ["SELECT FORM users"], strict_mode=True)
    assert row["total"] == 0.0 and not row["syntax_valid"]
    (row,) = scored(spark, ["SELECT a FROM t"], keywords=())
    assert row["keywords"] == 0.3
    (row,) = scored(spark, ["SELECT a FROM t"], keywords=("select", True, "a"))
    assert row["keywords"] == 0.6


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        RubricOptions(syntax_weight=0.9)


def test_long_response_scores_half_on_format(spark):
    (row,) = scored(spark, ["SELECT a FROM t " + "x" * 5000])
    assert row["format"] == 0.5 and len(row["extracted_sql"]) == 5016


def test_extraction_cascade(spark):
    cases = {
        "```sql\nSELECT * FROM users\n```": "SELECT * FROM users",
        "text\n```\nanything at all\n```": "anything at all",
        "```sql SELECT 1```": "SELECT 1```",
        "```sql SELECT a FROM b```": "sql SELECT a FROM b",
        "The query is `SELECT * FROM users`": "SELECT * FROM users",
        "Use `name` or `SELECT a FROM b` here": "SELECT a FROM b",
        "SELECT  *   FROM    users": "SELECT * FROM users",
        "SQL: SELECT a FROM t ;": "SELECT a FROM t;",
        "Here is the query: SELECT a FROM t": "Here is the query: SELECT a FROM t",
        "SELECT a FROM t\n\nThat is all": "SELECT a FROM t",
        "SELECT a FROM t\nNote: x\nExplanation: y": "SELECT a FROM t",
        "please delete then select something": "select something",
        "\U0001f600 please select": "select",
        "selection of words": "selection of words",
        "nothing here": None,
        "SELECT a\r FROM t": "SELECT a FROM t",
        " \n ": None,
    }
    assert extracted(spark, list(cases)) == list(cases.values())


def test_parser_options(spark):
    assert extracted(spark, ["```\nabc\n```"], extract_code_blocks=False) == [None]
    assert extracted(spark, ["SELECT  a FROM t"], clean_whitespace=False) == ["SELECT  a FROM t"]
    assert extracted(spark, ["SELECT a FROM t"], max_sql_length=8) == ["SELECT a"]


def test_parsed_response(spark):
    df = spark.createDataFrame([("SELECT a FROM t",), ("SELECT 1",), ("hm",), ("",), (None,)], "response string")
    rows = [r["parsed"] for r in reward.parse_responses(df).collect()]
    assert [r["valid"] for r in rows] == [True, False, False, False, False]
    assert [r["metadata"]["error"] for r in rows] == [
        None, None, "Failed to extract SQL", "Empty response", "Empty response",
    ]
    assert rows[0]["metadata"]["extracted_length"] == 15


def test_batch_statistics(spark):
    texts = ["```sql\nSELECT * FROM users\n```", "SELECT a FROM t", "INSERT INTO t VALUES (1)", "Not SQL"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "sample_id long, response string")
    row = reward.batch_statistics(reward.add_scores(df)).first()
    assert (row["count"], row["valid_sql_count"], row["valid_sql_percentage"]) == (4, 3, 75.0)
    assert row["mean_score"] == pytest.approx((0.88 + 0.88 + 0.85) / 4)
    empty = reward.batch_statistics(reward.add_scores(df.limit(0))).first()
    assert empty["count"] == 0 and empty["mean_score"] == 0.0


def test_schema_penalty(spark):
    responses = spark.createDataFrame(
        [(1, "SELECT a FROM users"), (2, "SELECT a FROM invoices"), (3, "SELECT a FROM invoices"), (4, "nope"), (5, "SELECT a FROM users")],
        "sample_id long, response string",
    )
    ddl = "CREATE TABLE Users (id INT, a TEXT)"
    samples = spark.createDataFrame([(1, ddl), (2, ddl), (3, None), (4, ddl)], "sample_id long, context string")
    got = {r["sample_id"]: r["reward"] for r in reward.rewards(responses, samples).collect()}
    assert got == pytest.approx({1: 0.88, 2: 0.88 * 0.7, 3: 0.88, 4: 0.0, 5: 0.88})


def test_one_text_scored_once(spark):
    hot = [(i, "SELECT * FROM users" if i % 3 else None) for i in range(300)]
    df = spark.createDataFrame(hot, "sample_id long, response string")
    a = {(r["sample_id"], r["total"]) for r in reward.add_scores(df).collect()}
    b = {(r["sample_id"], r["total"]) for r in reward.score_distinct(df).collect()}
    assert a == b and len(a) == 300


def test_advantages_with_a_hot_prompt(spark):
    rows = [(0, "m", c, float(c % 5)) for c in range(1000)]
    rows += [(s, "m", c, float(c)) for s in range(1, 400) for c in range(4)] + [(400, "m", 0, 1.0)]
    df = spark.createDataFrame(rows, "sample_id long, model string, candidate int, reward double")
    pdf = df.toPandas()
    groups = pdf.groupby("sample_id").reward
    pdf["advantage"] = (pdf.reward - groups.transform("mean")) / (groups.transform("std").fillna(0) + 1e-4)
    got = reward.relative_advantage(df).toPandas()
    both = pdf.merge(got, on=["sample_id", "candidate"])
    assert len(both) == len(pdf) == len(got)
    assert (both.advantage_x - both.advantage_y).abs().max() < 1e-9
