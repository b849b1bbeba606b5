"""Untidy tables derived from the test tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill import with_row_order
from gristmill.operators.store import keep

# Every kind of mess on top of all orders. copy_no tells the copies of an order apart.
MESSY_ORDERS = """
WITH base AS (
  SELECT o_orderkey AS order_id,
    CASE WHEN o_orderkey % 11 = 0 THEN 'N/A'
         WHEN o_orderkey % 11 = 1 THEN ' ? '
         WHEN o_orderkey % 11 = 2 THEN lower(o_orderstatus)
         WHEN o_orderkey % 11 = 3 THEN concat(o_orderstatus, ' ')
         ELSE o_orderstatus END AS status,
    CASE WHEN o_orderkey % 7 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS priority,
    CASE WHEN o_orderkey % 3 = 0 THEN concat(CAST(year(o_orderdate) AS STRING), '-',
                lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-', lpad(CAST(day(o_orderdate) AS STRING), 2, '0'))
         WHEN o_orderkey % 3 = 1 THEN concat(lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/',
                lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '/', CAST(year(o_orderdate) AS STRING))
         ELSE concat(CAST(day(o_orderdate) AS STRING), '-',
                substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(month(o_orderdate) * 3 - 2 AS INT), 3), '-',
                CAST(year(o_orderdate) AS STRING)) END AS order_date,
    CASE WHEN o_orderkey % 13 = 0 THEN '?'
         ELSE CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING) END AS amount,
    CASE o_orderkey % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'n' WHEN 2 THEN 'yes' ELSE 'NO' END AS urgent
  FROM {orders}
)
SELECT *, 0 AS copy_no FROM base
UNION ALL SELECT *, 1 AS copy_no FROM base WHERE order_id % 97 = 0
UNION ALL SELECT order_id, status, '9-OTHER' AS priority, order_date, amount, urgent, 2 AS copy_no
  FROM base WHERE order_id % 101 = 0
UNION ALL SELECT order_id, NULL AS status, NULL AS priority, NULL AS order_date, NULL AS amount, NULL AS urgent,
  3 AS copy_no FROM base WHERE order_id % 89 = 0
"""

# Orders whose customer key is missing now and then, and customers with one missing key.
KEYED_ORDERS = """
SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS cust_id, o_orderkey AS order_no,
  o_totalprice AS amount FROM {orders}
"""
KEYED_CUSTOMERS = "SELECT c_custkey AS cust_id, c_name AS name, c_acctbal AS amount FROM {customer}"
KEYED_SEGMENTS = """
SELECT CASE WHEN c_custkey = 7 THEN NULL ELSE c_custkey + 100 END AS Cust_ID, c_mktsegment AS segment FROM {customer}
"""

# Orders with their date as text.
DATED_ORDERS = """
SELECT concat(lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/', lpad(CAST(day(o_orderdate) AS STRING), 2, '0'),
  '/', CAST(year(o_orderdate) AS STRING)) AS ordered_on, o_totalprice AS amount, o_orderpriority AS priority,
  o_orderkey AS order_id FROM {orders}
"""

# CSV lines from all customers: null tokens, quoted commas, lines with a field too many or too few.
CUSTOMER_LINES = """
SELECT c_custkey AS k, concat(
  CAST(c_custkey AS STRING), ',',
  CASE WHEN c_custkey % 20 = 1 THEN concat('"', c_name, ', Inc."') ELSE c_name END, ',',
  CASE WHEN c_custkey % 10 = 3 THEN 'N/A' ELSE CAST(CAST(c_acctbal AS DECIMAL(18, 2)) AS STRING) END, ',',
  CASE WHEN c_custkey % 50 = 5 THEN 'north, east' WHEN c_custkey % 9 = 2 THEN ' ?' ELSE c_mktsegment END,
  CASE WHEN c_custkey % 33 = 4 THEN '' ELSE concat(',', lpad(CAST(c_nationkey AS STRING), 3, '0')) END) AS line
FROM {customer}
"""
CUSTOMER_FIELDS = ["cust_no", "name", "balance", "segment", "nation_code"]

# Texts that go into one CSV field: line breaks, quotes and commas taken out.
PLAIN_TEXTS = r"""
SELECT doc_id, regexp_replace(text, '[\n\r\t",]', ' '{all}) AS body FROM {documents}
"""


def table(spark: SparkSession, sf_dir: str, name: str, order: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df if order is None else with_row_order(df, order)


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = [n for n in ("orders", "customer", "documents") if f"{{{n}}}" in sql]
    sql = sql.replace("{all}", "")
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def dealt_out(df: DataFrame) -> DataFrame:
    """The test files hold one row group each, which one task would read. Real tables have many."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, df.columns[0])


def messy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The untidy orders as a stored table: written once, then read like any other input."""
    df = keep(dealt_out(derived(spark, sf_dir, MESSY_ORDERS)))
    return with_row_order(df, "order_id * 10 + copy_no").drop("copy_no")


def for_duckdb(sql: str) -> str:
    """The same recipe reading the tables by their plain names."""
    sql = sql.replace("{all}", ", 'g'")
    for name in ("orders", "customer", "documents"):
        sql = sql.replace(f"{{{name}}}", name)
    return sql
