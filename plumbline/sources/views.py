"""Derived views over the test tables: injected nulls, placeholders and drift.

The SQL text is shared with the checks; every view keeps all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIRTY_ORDERS = """
SELECT o_orderkey,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 7 = 0 THEN 'N/A' WHEN o_orderkey % 11 = 0 THEN ' unknown '
       WHEN o_orderkey % 13 = 0 THEN 'a#b' ELSE o_orderpriority END AS o_orderpriority,
  CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 50
       WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 17 = 0 THEN 'not-a-date'
       ELSE SUBSTR(CAST(o_orderdate AS STRING), 1, 10) END AS o_orderdate_txt,
  CAST(NULL AS DOUBLE) AS all_null,
  1 AS constant_one
FROM orders
"""

DRIFT_ORDERS = """
SELECT o_orderkey, o_orderdate,
  CASE WHEN o_orderdate < TIMESTAMP '1998-01-01 00:00:00' THEN 'baseline' ELSE 'target' END AS side,
  CASE WHEN o_orderdate < TIMESTAMP '1998-01-01 00:00:00' THEN o_totalprice ELSE o_totalprice * 1.3 END AS o_totalprice,
  CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' AND o_orderkey % 3 = 0
       THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority
FROM orders
"""

FD_CUSTOMER_NATION = """
SELECT c_custkey, c_nationkey,
  CASE WHEN c_custkey % 100 = 0 THEN 'BROKEN' ELSE n_name END AS n_name
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

CAUSAL_LINEITEM = """
SELECT l_orderkey * 100000 + l_partkey AS row_key,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS treatment,
  l_extendedprice AS outcome, l_linenumber AS stratum, l_quantity,
  l_linestatus, l_shipdate
FROM lineitem
"""

REPLY_ROWS = """
SELECT o_orderkey AS reply_id, o_orderstatus AS column_name,
  CASE WHEN o_orderkey % 3 = 0 THEN CONCAT('```json', CHR(10), '{"verdict":"inconsistent","reason":"r', CAST(o_orderkey % 8 AS STRING), '"}', CHR(10), '```')
       WHEN o_orderkey % 3 = 1 THEN '{"verdict":"consistent","reason":""}'
       WHEN o_orderkey % 5 = 0 THEN CONCAT('Here it is: {"verdict":"possibly inconsistent","reason":"r', CAST(o_orderkey % 4 AS STRING), '"} as asked')
       ELSE 'no json here' END AS reply
FROM orders
"""

TEXTS = {
    "dirty_orders": (DIRTY_ORDERS, ["orders"]),
    "drift_orders": (DRIFT_ORDERS, ["orders"]),
    "fd_customer_nation": (FD_CUSTOMER_NATION, ["customer", "nation"]),
    "causal_lineitem": (CAUSAL_LINEITEM, ["lineitem"]),
    "reply_rows": (REPLY_ROWS, ["orders"]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, sources = TEXTS[name]
    for source in sources:
        table(spark, sf_dir, source).createOrReplaceTempView(source)
    return spark.sql(text)


def with_views(sql: str, *names: str) -> str:
    """The query with the named views as CTEs, for an engine that has the tables only."""
    ctes = ",\n".join(f"{n} AS ({TEXTS[n][0]})" for n in names)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
