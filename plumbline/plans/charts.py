"""Chart data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import chartdata, relations, score
from plumbline.plans.drifts import DRIFT_SIDES, drift_sided
from plumbline.plans.profiles import CORR_SQL, NUMBERS, dirty_profile, over_dirty_profile
from plumbline.plans.registry import query, r6
from plumbline.sources.views import with_views


def hist_sql(source: str, name: str, extra: str = "", bins: int = 30) -> str:
    return f"""SELECT LEAST(FLOOR((v - lo) / ((hi - lo) / {bins}.0)), {bins - 1})::INTEGER AS bin{extra}, COUNT(*) AS n, ANY_VALUE(lo) AS lo, ANY_VALUE(hi) AS hi
      FROM (SELECT *, {name}::DOUBLE AS v FROM {source}), (SELECT MIN({name})::DOUBLE AS lo, MAX({name})::DOUBLE AS hi FROM {source}) WHERE v IS NOT NULL GROUP BY ALL"""


EDGES = "ROUND(lo + (hi - lo) / 30.0 * bin, 6) AS bin_low, ROUND(lo + (hi - lo) / 30.0 * (bin + 1), 6) AS bin_high"


@query("chart_histogram", f"SELECT bin, {EDGES}, hue, n FROM ({hist_sql('orders', 'o_totalprice', ', o_orderstatus AS hue')})")
def chart_histogram(t):
    return r6(chartdata.chart_histogram(t("orders"), "o_totalprice", hue="o_orderstatus"))


KDE_SQL = """WITH b AS (SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, STDDEV_SAMP(o_totalprice) * POW(COUNT(*), -0.2) AS h, COUNT(*) AS n FROM orders),
       g AS (SELECT i::INTEGER AS i, lo + (hi - lo) * i / 199.0 AS x, h, n FROM range(0, 200) r(i), b)
       SELECT i, ROUND(x, 6) AS x, ROUND(1e6 * SUM(EXP(-0.5 * ((x - o_totalprice) / h) ** 2)) / (ANY_VALUE(n) * ANY_VALUE(h) * SQRT(2 * PI())), 6) AS density_per_million
       FROM g, orders GROUP BY i, x"""


def kde(t):
    """The kernel summed over all values, none replaced by a bin's centre."""
    curve = chartdata.chart_kde(t("orders"), "o_totalprice")
    return r6(curve.select("i", "x", (F.col("density") * 1e6).alias("density_per_million")))


query("chart_kde", KDE_SQL)(kde)
query("chart_kde_values", KDE_SQL)(kde)  # the name under which the whole curve was first registered


@query("chart_value_counts", "SELECT event_type AS value, COUNT(*) AS n FROM events GROUP BY 1")
def chart_value_counts(t):
    return chartdata.chart_value_counts(t("events"), "event_type")


@query(
    "chart_pie_values",
    "SELECT c_mktsegment AS name, ROUND(SUM(c_acctbal), 4) AS total, ROUND(SUM(c_acctbal) / SUM(SUM(c_acctbal)) OVER (), 4) AS share FROM customer GROUP BY 1",
)
def chart_pie_values(t):
    return r6(chartdata.chart_pie_values(t("customer"), "c_mktsegment", "c_acctbal"), 4)


@query(
    "chart_bar",
    "SELECT l_returnflag AS x, l_linestatus AS hue, ROUND(SUM(l_quantity), 4) AS y, COUNT(*) AS n FROM lineitem GROUP BY 1, 2",
)
def chart_bar(t):
    return r6(chartdata.chart_bar(t("lineitem"), "l_returnflag", "l_quantity", "l_linestatus"), 4)


@query(
    "chart_line",
    """SELECT strftime(o_orderdate, '%Y-%m') AS x, o_orderstatus AS hue, ROUND(AVG(o_totalprice), 4) AS y, COUNT(*) AS n FROM orders GROUP BY 1, 2""",
)
def chart_line(t):
    monthly = t("orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return r6(chartdata.chart_line(monthly, "month", "o_totalprice", "o_orderstatus"), 4)


@query(
    "chart_scatter_ols",
    """SELECT l_returnflag AS hue, COUNT(*) AS n, ROUND(REGR_SLOPE(l_extendedprice, l_quantity), 5) AS slope, ROUND(REGR_INTERCEPT(l_extendedprice, l_quantity), 5) AS intercept,
       ROUND(REGR_R2(l_extendedprice, l_quantity), 5) AS r2 FROM lineitem GROUP BY 1""",
)
def chart_scatter_ols(t):
    return r6(chartdata.chart_scatter_ols(t("lineitem"), "l_quantity", "l_extendedprice", "l_returnflag"), 5)


@query("chart_scatter_points", "SELECT o_custkey AS x, o_totalprice AS y, o_orderstatus AS hue FROM orders")
def chart_scatter_points(t):
    return chartdata.scatter_points(t("orders"), "o_custkey", "o_totalprice", "o_orderkey", "o_orderstatus")


@query(
    "chart_box",
    """WITH q AS (SELECT o_orderpriority AS x, o_orderstatus AS hue, QUANTILE_CONT(o_totalprice, 0.25) AS q1, QUANTILE_CONT(o_totalprice, 0.5) AS m, QUANTILE_CONT(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1, 2)
       SELECT x, hue, COUNT(*) AS n, ROUND(ANY_VALUE(q1), 6) AS q1, ROUND(ANY_VALUE(m), 6) AS median, ROUND(ANY_VALUE(q3), 6) AS q3,
         MIN(o_totalprice) FILTER (o_totalprice >= q1 - 1.5 * (q3 - q1)) AS whisker_low, MAX(o_totalprice) FILTER (o_totalprice <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
         COUNT(*) FILTER (o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) AS n_beyond
       FROM orders JOIN q ON x = o_orderpriority AND hue = o_orderstatus GROUP BY x, hue""",
)
def chart_box(t):
    return r6(chartdata.chart_box(t("orders"), "o_orderpriority", "o_totalprice", "o_orderstatus"))


@query(
    "chart_corr_heatmap",
    f"SELECT col_a, col_b, ROUND(corr, 6) AS corr FROM (WITH h AS ({CORR_SQL}) SELECT * FROM h UNION ALL SELECT col_b, col_a, corr FROM h UNION ALL SELECT UNNEST({NUMBERS}), UNNEST({NUMBERS}), 1.0)",
)
def chart_corr_heatmap(t):
    return r6(relations.full_corr_matrix(t("lineitem"), NUMBERS))


@query(
    "chart_drift_overlay",
    with_views(
        f"SELECT bin, {EDGES}, COALESCE(SUM(n) FILTER (b), 0)::BIGINT AS baseline_n, COALESCE(SUM(n) FILTER (NOT b), 0)::BIGINT AS target_n FROM ({hist_sql(f'({DRIFT_SIDES})', 'o_totalprice', ', b')}) GROUP BY bin, lo, hi",
        "drift_orders",
    ),
)
def chart_drift_overlay(t):
    return r6(chartdata.chart_drift_overlay(drift_sided(t), "o_totalprice"))


@query(
    "chart_drift_shares",
    with_views(
        """SELECT o_orderpriority AS value, side AS period, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY side), 6) AS pct FROM drift_orders GROUP BY 1, 2""",
        "drift_orders",
    ),
)
def chart_drift_shares(t):
    return r6(chartdata.chart_drift_shares(drift_sided(t), "o_orderpriority"))


WORST_SQL = over_dirty_profile(
    """, worst AS (SELECT column_name FROM prof JOIN (VALUES ('o_orderkey', 0), ('o_custkey', 1), ('o_orderpriority', 2), ('o_totalprice', 3), ('o_orderdate_txt', 4), ('all_null', 5), ('constant_one', 6)) o(cn, idx) ON cn = column_name
         ORDER BY ROUND(dq_score, 9), idx LIMIT 3),
    dist AS (SELECT 'o_orderpriority' AS column_name, o_orderpriority AS label, COUNT(*) AS n FROM dirty_orders WHERE o_orderpriority IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'o_orderdate_txt', o_orderdate_txt, COUNT(*) FROM dirty_orders GROUP BY 2
      UNION ALL SELECT 'constant_one', '0', COUNT(*) FROM dirty_orders
      UNION ALL SELECT 'o_custkey', bin::VARCHAR, n FROM (""" + hist_sql("dirty_orders", "o_custkey") + """)
      UNION ALL SELECT 'o_totalprice', bin::VARCHAR, n FROM (""" + hist_sql("dirty_orders", "o_totalprice") + """))
    SELECT column_name, label, n FROM dist WHERE column_name IN (SELECT column_name FROM worst)"""
)


@query("chart_worst_columns", WORST_SQL)
def chart_worst_columns(t):
    ranking = score.score_ranking(r6(dirty_profile(t), 9))
    return chartdata.chart_worst_columns(t.view("dirty_orders"), ranking)
