"""CREATE TABLE text and prompts."""

import time

import pytest
from pyspark.sql import functions as F

from querymill.functions import ddl, prompting
from querymill.functions.prompting import PromptOptions
from querymill.operators import formatting


def test_schema_map(evaluate_expr):
    texts = [
        "CREATE TABLE users (id INT, name VARCHAR(100))",
        'create table if not exists `a` ("x" text, y DECIMAL(10,2), PRIMARY KEY (x)); CREATE TABLE b (z INT)',
        "CREATE TABLE t (a INT); CREATE TABLE t (b INT); CREATE TABLE s (c WEIRD);",
        None,
    ]
    assert evaluate_expr(texts, ddl.schema_map) == [
        {"users": ["id", "name"]}, {"a": ["x", "y"], "b": ["z"]}, {"t": ["b"]}, {},
    ]
    assert evaluate_expr(texts, ddl.table_names) == [["users"], ["a", "b"], ["t"], []]


def test_known_tables(evaluate_expr):
    tables = F.array(F.lit("USERS"))
    got = evaluate_expr(
        ["SELECT name FROM users", "SELECT name FROM products", "select 1", None, "SELECT a FROM x JOIN `Users` u"],
        lambda c: ddl.uses_known_table(c, tables),
    )
    assert got == [True, False, False, False, True]


def test_statements_and_truncation(evaluate_expr):
    two = "CREATE TABLE t1 (id INT); CREATE TABLE t2 (id INT);"
    assert evaluate_expr([two, "CREATE TABLE t (id INT)", None], ddl.table_count) == [2, 0, 0]
    long = "CREATE TABLE t1 (id INT);" * 100
    (cut,) = evaluate_expr([long], lambda c: ddl.truncate_schema(c, 100))
    assert cut == "\n".join(["CREATE TABLE t1 (id INT);"] * 3) and len(cut) <= 100
    assert evaluate_expr([long, "x" * 50], lambda c: ddl.truncate_schema(c, 10)) == ["CREATE TAB", "x" * 10]
    assert evaluate_expr([two], lambda c: ddl.truncate_schema(c, 1000)) == [two]


def test_layout_and_preview(evaluate_expr):
    assert evaluate_expr([" a \n\n\t b\n", None], ddl.format_schema) == ["a\nb", ""]
    texts = ["CREATE TABLE a (x INT); CREATE TABLE b (y INT);", "other; text", "", "CREATE TABLE " + "y" * 300]
    assert evaluate_expr(texts, ddl.schema_preview) == [
        "CREATE TABLE a (x INT)", "CREATE TABLEother", None, ("CREATE TABLE " + "y" * 300)[:200] + "...",
    ]


def test_templates_are_checked():
    with pytest.raises(ValueError):
        prompting.named_template("nope")
    with pytest.raises(ValueError):
        PromptOptions(template="nope")
    with pytest.raises(ValueError):
        PromptOptions(template="no placeholder here")
    assert PromptOptions(template="Ask: {question}").text == "Ask: {question}"


def test_missing_variable_fails_while_planning(spark):
    df = spark.createDataFrame([(1, "q", "s", "a")], "sample_id long, question string, context string, answer string")
    with pytest.raises(ValueError):
        formatting.format_raw_samples(df, PromptOptions(template="few_shot"))


def test_values_are_not_scanned_for_placeholders(spark):
    df = spark.createDataFrame([("{schema}", "{question}{{")], "q string, s string")
    text = prompting.prompt(F.col("q"), F.col("s"), opts=PromptOptions(template="{{x}} {question} / {schema}"))
    assert df.select(text).first()[0] == "{x} {schema} / {question}{{"


def test_few_shot_block(spark):
    df = spark.createDataFrame(
        [([("q1", "a1"), ("q2", "a2"), ("q3", "a3")],), ([],), (None,)],
        "e array<struct<question:string,answer:string>>",
    )
    got = [r[0] for r in df.select(prompting.few_shot_block(F.col("e"), 2)).collect()]
    assert got == [
        "Examples:\n\nExample 1:\nQuestion: q1\nSQL: a1\n\nExample 2:\nQuestion: q2\nSQL: a2", "", "",
    ]


def test_rows_without_question_or_examples_are_dropped(spark):
    rows = [(1, "q", "s", "a", [("x", "y")]), (2, "", "s", "a", [("x", "y")]), (3, "q", None, None, [])]
    df = spark.createDataFrame(
        rows, "sample_id long, question string, context string, answer string,"
        " ex array<struct<question:string,answer:string>>",
    )
    plain = formatting.format_raw_samples(df).orderBy("sample_id").collect()
    assert [(r["sample_id"], r["reference"], r["context"]) for r in plain] == [
        (1, "a", ("s",)), (3, "", None),
    ]
    shots = formatting.format_raw_samples(df, PromptOptions(template="few_shot", max_examples=1), "ex")
    assert [r["sample_id"] for r in shots.collect()] == [1]


def test_schema_can_be_left_out(spark):
    df = spark.createDataFrame([("q", "CREATE TABLE a (x INT)")], "q string, s string")
    opts = PromptOptions(template="concise", include_schema=False)
    assert df.select(prompting.prompt(F.col("q"), F.col("s"), opts=opts)).first()[0] == (
        "Schema: \n\nQuestion: q\n\nSQL:"
    )


def test_rough_column_count_takes_linear_time(evaluate_expr):
    given_ = ["a INTEGER INT", "x INT INT", "_x\t int, y  Text; 9 DATE", " INT", "x" * 200_000, None]
    start = time.monotonic()
    assert evaluate_expr(given_, ddl.rough_column_count) == [2, 1, 3, 0, 0, 0]
    assert time.monotonic() - start < 15
