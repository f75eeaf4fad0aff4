"""Text rules against Python's own string semantics, and cleaning examples."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querymill.functions import cleaning, text

ODD = [
    "", " ", "a b", "  a\t b \n", "\x1ca\x1db\x1f", "a\x85b", "x y　z", "tail\n\n", "é ü",
    "one two", "a​b", "\U0001f600 b",
]


def test_strip_collapse_count_follow_python(evaluate_expr):
    assert evaluate_expr(ODD, text.strip) == [s.strip() for s in ODD]
    assert evaluate_expr(ODD, text.collapse) == [re.sub(r"\s+", " ", s).strip() for s in ODD]
    assert evaluate_expr(ODD, text.word_count) == [len(s.split()) for s in ODD]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \t\n\x1c\x85\u00a0\u2003\u200b\u3000é", max_size=30), min_size=50, max_size=50))
def test_random_texts_follow_python(evaluate_expr, texts):
    assert evaluate_expr(texts, text.strip) == [s.strip() for s in texts]
    assert evaluate_expr(texts, text.word_count) == [len(s.split()) for s in texts]


def test_whitespace_classes_are_complementary():
    def java_to_python(cls):
        return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m.group(1), 16)), cls)

    non_ws = re.compile(java_to_python(text.NON_WS))
    for code in range(0x3100):
        c = chr(code)
        assert (c in text.WS_CHARS) == c.isspace(), hex(code)
        assert bool(non_ws.fullmatch(c)) != c.isspace(), hex(code)


def test_clean_question(evaluate_expr):
    given_ = [
        "  How  many   users?  ", "What\u2019s the total", "\u201cOpen\u201d ones.", "", None, "Stop!",
        "Count\u00a0orders\nhere",
    ]
    assert evaluate_expr(given_, cleaning.clean_question) == [
        "How many users?", "What's the total?", '"Open" ones.', "", "", "Stop!", "Count orders here?",
    ]


def test_clean_schema(evaluate_expr):
    table = "CREATE TABLE a (x INT);"
    given_ = [f"{table} -- note\n  /* more\nof it */ CREATE TABLE b (y INT);", None, table + " " + table]
    assert evaluate_expr(given_, cleaning.clean_schema) == [
        f"{table} CREATE TABLE b (y INT);", "", table + " " + table,
    ]
    # The second table starts at 99: beyond 80 % of 112 characters, outside of 100.
    wide = "CREATE TABLE a (" + "x" * 80 + ");"
    text_ = wide + " " + table
    assert evaluate_expr([text_], lambda c: cleaning.clean_schema(c, 28)) == [wide + " "]
    assert evaluate_expr([text_], lambda c: cleaning.clean_schema(c, 25)) == [text_[:100]]


def test_a_cut_schema_counts_its_words(evaluate_expr):
    cut = "CREATE TABLE a (x INT); "
    assert evaluate_expr([cut, "", None, "a"], text.clean_word_count) == [5, 0, 0, 1]


def test_clean_sql(evaluate_expr):
    given_ = [
        "select Name from Users where id=1", "SELECT * FROM t -- all\n", "/* x */", None,
        "SELECT COUNT(*), u.Name FROM Users u WHERE a='It''s  X' AND b>=-1",
        'select "Mixed" from t where a||b <> \'Q\'', "select t.* from t join s using (id)",
    ]
    assert evaluate_expr(given_, cleaning.clean_sql) == [
        "SELECT name FROM users WHERE id = 1", "SELECT * FROM t", "", "",
        "SELECT count(*), u.name FROM users u WHERE a = 'It''s X' AND b >= -1",
        'SELECT "Mixed" FROM t WHERE a || b <> \'Q\'', "SELECT t.* FROM t JOIN s USING (id)",
    ]


def test_long_literals_do_not_exhaust_the_stack(evaluate_expr):
    body = "x''" * 20000
    sql = f"SELECT '{body}' FROM t"
    assert evaluate_expr([sql], cleaning.clean_sql) == [sql]


def test_complexity(evaluate_expr):
    cases = {
        "SELECT * FROM users WHERE id = 1": "simple",
        "SELECT u.name, o.total FROM users u JOIN orders o ON u.id = o.user_id": "medium",
        "SELECT a FROM t GROUP BY a": "medium",
        "SELECT a FROM t WHERE b IN (SELECT b FROM s)": "medium",
        "SELECT a FROM t UNION SELECT b FROM s": "medium",
        "SELECT a FROM t JOIN s ON x = y JOIN r ON y = z": "complex",
        "WITH c AS (SELECT 1) SELECT * FROM c": "complex",
        "SELECT a FROM t WHERE b IN (SELECT b FROM s WHERE c IN (SELECT c FROM r))": "complex",
        "": "simple",
    }
    assert evaluate_expr(list(cases), cleaning.complexity_level) == list(cases.values())


def test_sample_keywords_are_substrings(evaluate_expr):
    (found,) = evaluate_expr(["SELECT MIN(a) FROM t LEFT JOIN s ORDER BY a"], cleaning.sample_keywords)
    assert found == ["SELECT", "FROM", "JOIN", "LEFT JOIN", "ORDER BY", "MIN", "IN", "OR"]


def test_validation_error(spark):
    df = spark.createDataFrame(
        [("How?", "SELECT 1"), ("", "SELECT 1"), (" \u00a0", "x"), ("How?", None), ("How?", "INVALID SQL SYNTAX")],
        "q string, a string",
    )
    got = [r[0] for r in df.select(cleaning.validation_error(F.col("q"), F.col("a"))).collect()]
    assert got == [None, "Empty question", "Empty question", "Empty answer (SQL)", None]
