"""Sources, sinks and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import review, stats
from plumbline.plans.registry import query, r6
from plumbline.sources.scratch import scratch_path
from plumbline.sources.tables import scan_csv, sink_csv


@query("scan_parquet", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def scan_parquet(t):
    return t("supplier")


@query(
    "scan_csv",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
              strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders""",
)
def scan_csv_round_trip(t):
    path = scratch_path(t.spark, "orders-csv")
    sink_csv(t("orders"), path)
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    return scan_csv(t.spark, path, schema).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query(
    "sink_csv",
    """SELECT column_name, CAST(n AS BIGINT) AS n, unique_values FROM (
         SELECT 'l_returnflag' AS column_name, COUNT(*) AS n, COUNT(DISTINCT l_returnflag) AS unique_values FROM lineitem
         UNION ALL SELECT 'l_quantity', COUNT(*), COUNT(DISTINCT l_quantity) FROM lineitem)""",
)
def sink_csv_result(t):
    """A result table written as one CSV file and read back with inferred types."""
    result = stats._with_distinct(t("lineitem"), ["l_returnflag", "l_quantity"]).select(
        "column_name", "n", F.col("n_unique").alias("unique_values")
    )
    path = scratch_path(t.spark, "profile-csv")
    sink_csv(result, path, single_file=True)
    read = scan_csv(t.spark, path)
    return read.select("column_name", F.col("n").cast("bigint"), F.col("unique_values").cast("bigint"))


@query("dataset_overview", "SELECT COUNT(*) AS n_rows, CAST(11 AS INTEGER) AS n_columns FROM lineitem")
def overview(t):
    return stats.dataset_overview(t("lineitem"))


@query(
    "dataset_first_rows",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 5",
)
def first_rows(t):
    return stats.first_rows(t("orders").drop("o_orderdate"), ["o_orderkey"], 5)


@query("sample_cap")
def sample_cap(t):
    return review.sample_cap(t("orders"), "o_orderkey", rows=5000)


@query("sample_batches")
def sample_batches(t):
    return review.sample_batches(t("orders"), "o_orderkey")


@query(
    "sample_values",
    """
WITH vf AS (
  SELECT 'p_brand' AS column_name, p_brand AS value, COUNT(*) AS n FROM part GROUP BY p_brand
  UNION ALL SELECT 'p_type', p_type, COUNT(*) FROM part GROUP BY p_type
  UNION ALL SELECT 'p_name', p_name, COUNT(*) FROM part GROUP BY p_name),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM vf)
SELECT column_name, CAST(rank AS INTEGER) AS rank, value, n FROM ranked WHERE rank <= 5""",
)
def sample_values(t):
    return r6(stats.sample_values(t("part"), ["p_brand", "p_type", "p_name"], 5))
