"""SQL surface, joins and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import drift, reshape
from plumbline.operators.score import profile
from plumbline.operators.sqlview import run_sql
from plumbline.plans.registry import query, r6
from plumbline.sources.views import with_views


def _sql(name: str, text: str, sql: str, *tables: str):
    """Register SQL that runs over views: the first table is visible as ``df``."""

    @query(name, sql)
    def plan(t):
        views = {("df" if i == 0 else n): t(n) for i, n in enumerate(tables)}
        return run_sql(text, **views)

    return plan


_sql(
    "sql_query",
    """```sql
WITH big AS (SELECT o_custkey, o_totalprice FROM df WHERE o_totalprice > 200000)
SELECT c_mktsegment, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total
FROM big JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
```""",
    """SELECT c_mktsegment, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total
       FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000 GROUP BY c_mktsegment""",
    "orders",
    "customer",
)
_sql(
    "sql_group_avg",
    "SELECT o_orderpriority, ROUND(AVG(o_totalprice), 6) AS average_price FROM df GROUP BY o_orderpriority",
    "SELECT o_orderpriority, ROUND(AVG(o_totalprice), 6) AS average_price FROM orders GROUP BY o_orderpriority",
    "orders",
)
_sql(
    "sql_top_k",
    "SELECT c_custkey, c_acctbal FROM df ORDER BY c_acctbal DESC, c_custkey LIMIT 5",
    "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5",
    "customer",
)
_sql(
    "sql_filtered_sum",
    """SELECT o_orderpriority, ROUND(SUM(o_totalprice), 2) AS total FROM df
       WHERE o_orderdate >= TIMESTAMP '1997-06-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-09-01 00:00:00'
         AND o_orderstatus = 'O' GROUP BY o_orderpriority""",
    """SELECT o_orderpriority, ROUND(SUM(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS total FROM orders
       WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-06-01' AND DATE '1997-08-31' AND o_orderstatus = 'O'
       GROUP BY o_orderpriority""",
    "orders",
)
_sql(
    "sql_project_filter",
    "SELECT c_custkey, c_acctbal * 2 AS doubled, UPPER(c_mktsegment) AS segment FROM df WHERE c_acctbal < 0 OR c_nationkey IN (1, 2, 3)",
    "SELECT c_custkey, c_acctbal + c_acctbal AS doubled, UPPER(c_mktsegment) AS segment FROM customer WHERE c_acctbal < 0 OR c_nationkey BETWEEN 1 AND 3",
    "customer",
)
_sql(
    "sql_distinct",
    "SELECT DISTINCT p_brand, p_size FROM df",
    "SELECT p_brand, p_size FROM part GROUP BY ALL",
    "part",
)
_sql(
    "sql_having",
    "SELECT o_custkey, COUNT(*) AS n FROM df GROUP BY o_custkey HAVING COUNT(*) > 10",
    "SELECT o_custkey, n FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) WHERE n >= 11",
    "orders",
)
_sql(
    "sql_self_join",
    """SELECT a.l_linenumber AS line, COUNT(*) AS n, ROUND(SUM(b.q - a.q), 2) AS gap
       FROM (SELECT l_orderkey, l_linenumber, SUM(l_quantity) AS q FROM df GROUP BY l_orderkey, l_linenumber) a
       JOIN (SELECT l_orderkey, l_linenumber, SUM(l_quantity) AS q FROM df GROUP BY l_orderkey, l_linenumber) b
         ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
       GROUP BY a.l_linenumber""",
    """WITH s AS (SELECT l_orderkey AS k, l_linenumber AS line, SUM(l_quantity) AS q FROM lineitem GROUP BY ALL),
       w AS (SELECT line, q, LEAD(line) OVER o AS next_line, LEAD(q) OVER o AS next_q FROM s WINDOW o AS (PARTITION BY k ORDER BY line))
       SELECT line, COUNT(*) AS n, ROUND(SUM(next_q - q), 2) AS gap FROM w WHERE next_line = line + 1 GROUP BY line""",
    "lineitem",
)
_sql(
    "sql_set_ops",
    """SELECT 'both' AS part, o_custkey AS k FROM (SELECT o_custkey FROM df WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM df WHERE o_orderstatus = 'O')
       UNION ALL SELECT 'only_f', o_custkey FROM (SELECT o_custkey FROM df WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM df WHERE o_orderstatus = 'O')""",
    """SELECT CASE WHEN BOOL_OR(o_orderstatus = 'O') THEN 'both' ELSE 'only_f' END AS part, o_custkey AS k
       FROM orders GROUP BY o_custkey HAVING BOOL_OR(o_orderstatus = 'F')""",
    "orders",
)
_sql(
    "sql_window",
    """SELECT o_orderkey, o_custkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place,
              ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), 2) AS running FROM df""",
    """SELECT o_orderkey, o_custkey, CAST(RANK() OVER w AS INTEGER) AS place, ROUND(SUM(o_totalprice) OVER w, 2) AS running
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""",
    "orders",
)
_sql(
    "sql_subquery",
    """SELECT c_custkey, c_acctbal FROM df
       WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM df)
         AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""",
    """WITH m AS (SELECT AVG(c_acctbal) AS a FROM customer), p AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P')
       SELECT c_custkey, c_acctbal FROM customer JOIN p ON o_custkey = c_custkey, m WHERE c_acctbal > a""",
    "customer",
    "orders",
)


@query(
    "apply_filter",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderstatus <> 'F'",
)
def apply_filter(t):
    kept = drift.apply_filter(t("orders"), "o_totalprice >= 1000 and o_totalprice <= 50000 and not (o_orderstatus = 'F')")
    return kept.select("o_orderkey", "o_totalprice")


# ------------------------------------------------------------------ joins, reshaping
@query(
    "join_membership_rate",
    """SELECT COUNT(doc_id) AS n, CAST(SUM(CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 ELSE 0 END) AS BIGINT) AS matched,
       ROUND(AVG(CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1.0 ELSE 0.0 END), 6) AS rate FROM documents""",
)
def join_membership_rate(t):
    return r6(reshape.membership_rate(t("documents"), "doc_id", t("labels"), "doc_id"))


@query(
    "join_fk_anti",
    """SELECT d.doc_id, d.lang, d.source FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id
       WHERE l.doc_id IS NULL""",
)
def join_fk_anti(t):
    return reshape.dangling_rows(t("documents").select("doc_id", "lang", "source"), "doc_id", t("labels"), "doc_id")


@query(
    "join_complement",
    with_views(
        "SELECT o_orderkey, o_custkey FROM dirty_orders WHERE o_totalprice IS NULL OR o_totalprice > 100000", "dirty_orders"
    ),
)
def join_complement(t):
    df = t.view("dirty_orders")
    return reshape.complement(df, F.expr("o_totalprice <= 100000")).select("o_orderkey", "o_custkey")


@query(
    "join_full_outer_counts",
    with_views(
        """SELECT COALESCE(b.v, c.v) AS value, COALESCE(b.n, 0) AS baseline_n, COALESCE(c.n, 0) AS target_n FROM
       (SELECT o_orderpriority AS v, COUNT(*) AS n FROM drift_orders WHERE side = 'baseline' GROUP BY 1) b FULL OUTER JOIN
       (SELECT o_orderpriority AS v, COUNT(*) AS n FROM drift_orders WHERE side = 'target' GROUP BY 1) c ON b.v = c.v""",
        "drift_orders",
    ),
)
def join_full_outer_counts(t):
    return reshape.side_counts(t.view("drift_orders"), "o_orderpriority", "side", "baseline", "target")


@query(
    "join_profile_lookup",
    """WITH rules AS (SELECT DISTINCT o_orderstatus AS rule, 'o_totalprice' AS column_name FROM orders
                      UNION ALL SELECT DISTINCT o_orderpriority, 'o_custkey' FROM orders),
       p AS (SELECT 'o_totalprice' AS column_name, COUNT(DISTINCT o_totalprice) AS n_unique, MIN(o_totalprice) AS min, MAX(o_totalprice) AS max FROM orders
             UNION ALL SELECT 'o_custkey', COUNT(DISTINCT o_custkey), MIN(o_custkey), MAX(o_custkey) FROM orders)
       SELECT column_name, rule, n_unique, CAST(min AS DOUBLE) AS min, CAST(max AS DOUBLE) AS max FROM rules LEFT JOIN p USING (column_name)""",
)
def join_profile_lookup(t):
    orders = t("orders")
    rules = (
        orders.select(F.col("o_orderstatus").alias("rule"), F.lit("o_totalprice").alias("column_name"))
        .distinct()
        .unionByName(orders.select(F.col("o_orderpriority").alias("rule"), F.lit("o_custkey").alias("column_name")).distinct())
    )
    profiled = profile(orders.select("o_custkey", "o_totalprice"), as_of="2002-01-01 00:00:00")
    return reshape.profile_lookup(rules, profiled, ["n_unique", "min", "max"])


@query(
    "union_tagged",
    """SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01 00:00:00' THEN 'baseline' ELSE 'target' END AS period, o_orderkey, o_totalprice FROM orders""",
)
def union_tagged(t):
    orders, before = t("orders").select("o_orderkey", "o_totalprice", "o_orderdate"), "o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'"
    tagged = reshape.union_tagged(
        {"baseline": drift.apply_filter(orders, before), "target": reshape.complement(orders, F.expr(before))}
    )
    return tagged.drop("o_orderdate")


@query(
    "unpivot",
    """SELECT l_returnflag, measure, ROUND(total, 2) AS total FROM (
       SELECT l_returnflag, 'quantity' AS measure, SUM(l_quantity) AS total FROM lineitem GROUP BY 1
       UNION ALL SELECT l_returnflag, 'price', SUM(l_extendedprice) FROM lineitem GROUP BY 1)""",
)
def unpivot(t):
    wide = t("lineitem").groupBy("l_returnflag").agg(
        F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price")
    )
    return r6(reshape.unpivot(wide, ["l_returnflag"], ["quantity", "price"], "measure", "total"), 2)


@query(
    "crosstab",
    with_views(
        """SELECT COALESCE(o_orderpriority, '__NA__') AS value_a, COALESCE(CAST(o_custkey % 3 AS VARCHAR), '__NA__') AS value_b, COUNT(*) AS n
           FROM dirty_orders GROUP BY 1, 2""",
        "dirty_orders",
    ),
)
def crosstab(t):
    df = t.view("dirty_orders").withColumn("third", F.col("o_custkey") % 3)
    return reshape.crosstab(df, "o_orderpriority", "third")
