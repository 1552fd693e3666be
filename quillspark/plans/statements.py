"""Statement texts made from orders and customers: inputs on which every matcher has something to find.

One query in a dialect that Spark and other engines share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STATEMENT_SQL = """
SELECT o_orderkey,
  CASE o_orderkey % 6
    WHEN 0 THEN y || m || d || '_' || key || '.pdf'
    WHEN 1 THEN y || '.' || m || ' - scan ' || key || '.pdf'
    WHEN 2 THEN y || '-' || m || '-' || d || ' scan.PDF'
    WHEN 3 THEN y || '-13-45 scan.pdf'
    WHEN 4 THEN 'chase scan ' || key || '.pdf'
    ELSE 'scan_' || key || '.pdf' END AS filename,
  CASE c_nationkey % 8
    WHEN 0 THEN 'Chase' WHEN 1 THEN 'Bank of America' WHEN 2 THEN 'Wells-Fargo' WHEN 3 THEN 'Purchase Corner'
    WHEN 4 THEN 'GEICO insurance' WHEN 5 THEN 'Citibank.com' WHEN 6 THEN 'the amexpress' ELSE 'Nobody' END || chr(10) ||
  CASE o_orderkey % 4 WHEN 0 THEN 'Dear John Smith,' || chr(10) WHEN 1 THEN 'Cardholder: Mary' || chr(10) ELSE '' END ||
  CASE o_orderkey % 5
    WHEN 0 THEN 'Account number: ' || lpad(CAST(o_custkey AS STRING), 9, '1')
    WHEN 1 THEN 'card ending in ' || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0')
    WHEN 2 THEN 'XXXX' || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0')
    WHEN 3 THEN 'acct # 12-' || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0')
    ELSE 'last 3 digits: ' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') END || chr(10) ||
  CASE WHEN o_orderkey % 9 = 0 THEN 'Date of Birth: 01/02/1970' || chr(10) ELSE '' END ||
  CASE o_orderkey % 8
    WHEN 0 THEN 'Billing Period: ' || mon || ' ' || d || ' - Jan 07, ' || y
    WHEN 1 THEN 'Issued ' || mon || ' ' || CAST(CAST(d AS INT) AS STRING) || ', ' || y
    WHEN 2 THEN 'Issued ' || m || '/' || d || '/' || y
    WHEN 3 THEN 'Issued ' || d || '/' || m || '/' || y
    WHEN 4 THEN 'Issued ' || y || '-' || m || '-' || d
    WHEN 5 THEN 'Invoice 12 2024 then ' || mon || ' ' || d || ', ' || y
    WHEN 6 THEN 'form year ' || y
    ELSE 'no date' END || chr(10) ||
  CASE c_mktsegment
    WHEN 'HOUSEHOLD' THEN 'credit card with minimum payment due and available credit'
    WHEN 'MACHINERY' THEN 'amount due for the service address, due date below'
    WHEN 'FURNITURE' THEN 'checking account with an ending balance'
    WHEN 'AUTOMOBILE' THEN 'form 1040 for the internal revenue service'
    ELSE 'lease agreement' END || chr(10) ||
  CASE o_orderkey % 7
    WHEN 0 THEN 'Statement Balance: $' || money
    WHEN 1 THEN 'Amount Due: $0.00' || chr(10) || 'Credit line $2,800.00'
    WHEN 2 THEN 'PAGO  DEL MES (suma) ' || repeat('-', 200) || ' = S/ ' || money
    WHEN 3 THEN 'paid $ ' || money
    WHEN 4 THEN 'New balance 0.50, then ' || money || ' €'
    WHEN 5 THEN 'Total due £' || money
    ELSE 'nothing owed' END || chr(10) ||
  CASE WHEN o_orderkey % 10 = 3 THEN repeat('filler words here. ', 120) || 'Discover' ELSE '' END AS text,
  c_mktsegment, o_custkey
FROM (
  SELECT o.o_orderkey, o.o_custkey, c.c_nationkey, c.c_mktsegment,
    CAST(o.o_orderkey AS STRING) AS key, CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) AS STRING) AS money,
    CAST(year(o.o_orderdate) AS STRING) AS y, lpad(CAST(month(o.o_orderdate) AS STRING), 2, '0') AS m,
    lpad(CAST(day(o.o_orderdate) AS STRING), 2, '0') AS d,
    CASE month(o.o_orderdate) WHEN 1 THEN 'January' WHEN 2 THEN 'Feb' WHEN 3 THEN 'March' WHEN 4 THEN 'Apr' WHEN 5 THEN 'May'
      WHEN 6 THEN 'June' WHEN 7 THEN 'Jul' WHEN 8 THEN 'August' WHEN 9 THEN 'Sep' WHEN 10 THEN 'October' WHEN 11 THEN 'Nov'
      ELSE 'December' END AS mon
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey) s
"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, filename, text, c_mktsegment, o_custkey) per order."""
    spread(spark.read.parquet(f"{sf_dir}/orders.parquet")).createOrReplaceTempView("orders")
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    return spark.sql(STATEMENT_SQL)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a small file would give them to one task; larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
