"""A text-to-SQL corpus and model responses derived from the orders table.

The CASE texts read the same in Spark SQL and in DuckDB. ``RAW_CTE`` and ``GENERATIONS_CTE`` are
prefixed to the DuckDB queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


RAW_COLUMNS = """
  CAST(k AS BIGINT) AS sample_id,
  CASE t
    WHEN 0 THEN 'How many orders did customer ' || CAST(c AS STRING) || ' place'
    WHEN 1 THEN '  Which   customers have priority ' || p || '?  '
    WHEN 2 THEN 'What’s the total for order ' || CAST(k AS STRING)
    WHEN 3 THEN 'List the “open” orders of customer ' || CAST(c AS STRING) || '.'
    WHEN 4 THEN 'Count orders per' || chr(160) || 'priority'
    WHEN 5 THEN 'Name every customer with an order' || chr(10) || 'above the average total'
    WHEN 6 THEN 'Show customers, orders and nations for order ' || CAST(k AS STRING)
    WHEN 7 THEN 'Rank customers using a common table expression'
    WHEN 8 THEN 'Orders or parts named ' || p || '?'
    WHEN 9 THEN ''
    WHEN 10 THEN 'Comment only answer?'
    ELSE 'Total' END AS question,
  CASE
    WHEN t = 8 THEN CAST(NULL AS STRING)
    WHEN t IN (1, 5) THEN 'CREATE TABLE customer (c_custkey INT, c_name VARCHAR(25)); CREATE TABLE orders (o_orderkey INT, o_custkey INT, o_totalprice DECIMAL(15,2))'
    WHEN t IN (6, 7) THEN 'CREATE TABLE customer (c_custkey INT, c_name VARCHAR(25), c_nationkey INT);' || chr(10) || '  CREATE TABLE orders (o_orderkey INT, o_custkey INT, o_orderdate DATE); -- facts' || chr(10) || 'CREATE TABLE nation (n_nationkey INT, n_name TEXT);'
    ELSE 'CREATE TABLE orders (o_orderkey INT, /* pk */ o_custkey INT, o_orderpriority VARCHAR(15), o_totalprice FLOAT);' END AS context,
  CASE t
    WHEN 0 THEN 'select count(*) from orders where o_custkey=' || CAST(c AS STRING)
    WHEN 1 THEN 'SELECT c_name FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderpriority = ''' || p || ''''
    WHEN 2 THEN 'SELECT o_totalprice  FROM  orders WHERE o_orderkey = ' || CAST(k AS STRING) || ' -- by key'
    WHEN 3 THEN 'SELECT * FROM orders WHERE o_custkey = ' || CAST(c AS STRING) || ' AND o_orderstatus = ''O'''
    WHEN 4 THEN 'SELECT o_orderpriority, COUNT(*) FROM orders GROUP BY o_orderpriority'
    WHEN 5 THEN 'SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders))'
    WHEN 6 THEN 'SELECT c_name, n_name FROM customer INNER JOIN orders ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey = ' || CAST(k AS STRING)
    WHEN 7 THEN 'WITH t AS (SELECT o_custkey, SUM(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT * FROM t ORDER BY s DESC LIMIT 10'
    WHEN 8 THEN 'SELECT o_orderkey FROM orders UNION SELECT p_partkey FROM part'
    WHEN 9 THEN 'INVALID SQL SYNTAX'
    WHEN 10 THEN '/* nothing */ -- nothing'
    ELSE 'SELECT SUM(o_totalprice) FROM orders' END AS answer
"""
BASE_COLUMNS = (
    "o_orderkey AS k, o_custkey AS c, o_orderpriority AS p, CAST(o_orderkey % 12 AS INT) AS t"
)
RESPONSE_TEXT = """
  CASE CAST((sample_id * 7 + candidate) % 9 AS INT)
    WHEN 0 THEN answer
    WHEN 1 THEN '```sql' || chr(10) || answer || chr(10) || '```'
    WHEN 2 THEN 'The query is `' || answer || '`'
    WHEN 3 THEN 'Here is the query: ' || answer || chr(10) || 'Explanation: it reads the table'
    WHEN 4 THEN replace(replace(answer, 'FROM ', 'FORM '), 'from ', 'form ')
    WHEN 5 THEN 'This is not a query'
    WHEN 6 THEN replace(answer, 'orders', 'invoices')
    WHEN 7 THEN answer || '...'
    ELSE '' END
"""

RAW_CTE = f"""
  base AS (SELECT {BASE_COLUMNS} FROM orders),
  raw AS (SELECT {RAW_COLUMNS} FROM base)"""
GENERATIONS_CTE = f"""{RAW_CTE},
  gens AS (
    SELECT sample_id, candidate, 'model_' || CAST(candidate % 2 AS STRING) AS model,
      {RESPONSE_TEXT} AS response
    FROM raw CROSS JOIN (SELECT UNNEST([0, 1, 2, 3]) AS candidate) c)"""


def _columns(text: str) -> list[str]:
    """The select list one expression at a time (no CASE branch holds a line that starts so)."""
    out: list[str] = []
    for line in text.strip().splitlines():
        if line.startswith("CAST(k") or line.startswith("  CASE"):
            out.append("")
        out[-1] += line + "\n"
    return [c.strip().rstrip(",") for c in out]


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample_id, question, context, answer``, one sample per order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderpriority"
    )
    base = orders.selectExpr(*BASE_COLUMNS.split(", "))
    return base.selectExpr(*_columns(RAW_COLUMNS))


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample_id, candidate, model, response``: four answers of two models per sample."""
    answers = raw_samples(spark, sf_dir).select(
        "sample_id", "answer", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("candidate")
    )
    return answers.selectExpr(
        "sample_id",
        "candidate",
        "'model_' || CAST(candidate % 2 AS STRING) AS model",
        f"{RESPONSE_TEXT.strip()} AS response",
    )
