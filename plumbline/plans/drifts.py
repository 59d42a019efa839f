"""Drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import drift
from plumbline.plans.registry import query, r6
from plumbline.sources.views import with_views

BEFORE_98 = "o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'"
SQL_98 = "o_orderdate < TIMESTAMP '1998-01-01 00:00:00'"
ORDER_SIDES = f"SELECT *, {SQL_98} AS b FROM orders"
DRIFT_SIDES = "SELECT *, side = 'baseline' AS b FROM drift_orders"


def orders_sided(t):
    return drift.split_by_filter(t("orders"), BEFORE_98)


def drift_sided(t):
    return drift.split_by_filter(t.view("drift_orders"), "side = 'baseline'", "side = 'target'").drop("side")


# ---------------------------------------------------------------- SQL building blocks
def edges_sql(values: str) -> str:
    """List of bin edges of the column v of a subquery."""
    deciles = ", ".join(f"{i / 10}" for i in range(11))
    return f"""(SELECT CASE WHEN len(list_distinct(q)) > 2 THEN list_sort(list_distinct(q))
        ELSE list_transform(range(0, 11), lambda i: q[1] + (q[11] - q[1]) / 10.0 * i) END
      FROM (SELECT QUANTILE_CONT(v, [{deciles}]) AS q FROM {values}))"""


def psi_sql(base: str, target: str, open_ends: bool = False) -> str:
    """Scalar: PSI of column v of two subqueries over the base's distinct deciles."""
    bin_ = "LEAST(GREATEST(len(list_filter(e, lambda x: x <= v)), 1), len(e) - 1)"
    inside = "TRUE" if open_ends else "v BETWEEN e[1] AND e[len(e)]"
    return f"""(WITH ed AS (SELECT {edges_sql(base)} AS e),
      hb AS (SELECT {bin_} AS k, COUNT(*) AS n FROM {base}, ed WHERE {inside} GROUP BY 1),
      ht AS (SELECT {bin_} AS k, COUNT(*) AS n FROM {target}, ed WHERE {inside} GROUP BY 1),
      bins AS (SELECT UNNEST(range(1, len(e))) AS k FROM ed),
      s AS (SELECT COALESCE(NULLIF(COALESCE(hb.n, 0) / ((SELECT SUM(n) FROM hb) + 1e-8), 0), 1e-8) AS p,
                   COALESCE(NULLIF(COALESCE(ht.n, 0) / ((SELECT SUM(n) FROM ht) + 1e-8), 0), 1e-8) AS q
            FROM bins LEFT JOIN hb USING (k) LEFT JOIN ht USING (k))
      SELECT SUM((p - q) * LN(p / q)) FROM s)"""


def ks_sql(base: str, target: str) -> str:
    """(d, n1, n2) of column v of two subqueries."""
    return f"""(SELECT MAX(ABS(cb / nb - ct / nt)) AS d, MAX(nb) AS n1, MAX(nt) AS n2 FROM (
      SELECT SUM(b) OVER (ORDER BY v) AS cb, SUM(t) OVER (ORDER BY v) AS ct, SUM(b) OVER () AS nb, SUM(t) OVER () AS nt FROM (
        SELECT v, SUM(b) AS b, SUM(t) AS t FROM (SELECT v, 1 AS b, 0 AS t FROM {base} UNION ALL SELECT v, 0, 1 FROM {target}) GROUP BY v)))"""


KS_P = """CASE WHEN lam < 0.2 THEN 1.0 ELSE LEAST(1, GREATEST(0,
   list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * EXP(-2.0 * k * k * lam * lam))))) END"""
LAM = "(SQRT(n1 * n2 / (n1 + n2)) + 0.12 + 0.11 / SQRT(n1 * n2 / (n1 + n2))) * d"


def chi2_sql(source: str, name: str, flag: str = "b") -> str:
    """(chi2, dof, psi, nb, nt) of a categorical column by a boolean side."""
    return f"""(SELECT SUM((o1 - e1) ** 2 / e1 + (o2 - e2) ** 2 / e2) AS chi2, COUNT(*) - 1 AS dof,
        SUM((p - q) * LN(p / q)) AS psi, ANY_VALUE(nb) AS nb, ANY_VALUE(nt) AS nt FROM (
      SELECT o1, o2, nb, nt, (o1 + o2) * nb / (nb + nt) AS e1, (o1 + o2) * nt / (nb + nt) AS e2,
        CASE WHEN o1 = 0 THEN 1e-8 ELSE o1 / nb END AS p, CASE WHEN o2 = 0 THEN 1e-8 ELSE o2 / nt END AS q FROM (
        SELECT COUNT(*) FILTER ({flag}) AS o1, COUNT(*) FILTER (NOT {flag}) AS o2,
          SUM(COUNT(*) FILTER ({flag})) OVER () AS nb, SUM(COUNT(*) FILTER (NOT {flag})) OVER () AS nt
        FROM {source} GROUP BY COALESCE({name}::VARCHAR, '__NA__'))))"""


# the tail has a closed form for an even number of degrees of freedom
CHI2_P_EVEN = "EXP(-chi2 / 2) * list_sum(list_transform(range(0, dof // 2), lambda i: EXP(i * LN(chi2 / 2) - LGAMMA(i + 1))))"


def side(source: str, name: str, flag: bool) -> str:
    return f"(SELECT {name}::DOUBLE AS v FROM ({source}) WHERE {'b' if flag else 'NOT b'} AND {name} IS NOT NULL)"


def numeric_psi_row(source: str, name: str) -> str:
    b, c = side(source, name, True), side(source, name, False)
    return f"""SELECT '{name}' AS column_name, ROUND({psi_sql(b, c)}, 6) AS psi,
      ROUND((SELECT 100.0 * COUNT(*) FILTER (v < lo OR v > hi) / COUNT(*) FROM {c}, (SELECT MIN(v) AS lo, MAX(v) AS hi FROM {b})), 6) AS out_of_range_pct"""


# ------------------------------------------------------------------------- measures
@query("psi_numeric", with_views(numeric_psi_row(DRIFT_SIDES, "o_totalprice"), "drift_orders"))
def psi_numeric(t):
    return r6(drift.psi_numeric(drift_sided(t), ["o_totalprice"]))


LINE_SIDES = "SELECT *, l_shipdate < TIMESTAMP '1998-01-01' AS b FROM lineitem"


@query(
    "psi_numeric_discrete",
    f"{numeric_psi_row(LINE_SIDES, 'l_discount')} UNION ALL {numeric_psi_row(LINE_SIDES, 'l_quantity')} UNION ALL {numeric_psi_row(LINE_SIDES, 'l_extendedprice')}",
)
def psi_numeric_discrete(t):
    """Columns whose deciles repeat."""
    sided = drift.split_by_filter(t("lineitem"), "l_shipdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    return r6(drift.psi_numeric(sided, ["l_discount", "l_quantity", "l_extendedprice"]))


@query(
    "psi_numeric_open_ends",
    with_views(f"SELECT 'o_totalprice' AS column_name, ROUND({psi_sql(side(DRIFT_SIDES, 'o_totalprice', True), side(DRIFT_SIDES, 'o_totalprice', False), True)}, 6) AS psi", "drift_orders"),
)
def psi_numeric_open(t):
    return r6(drift.psi_numeric(drift_sided(t), ["o_totalprice"], open_ends=True).select("column_name", "psi"))


def psi_profile_sql(source: str, name: str) -> str:
    b, c = side(source, name, True), side(source, name, False)
    return f"""SELECT '{name}' AS column_name, ROUND(SUM(CASE WHEN e > 0 AND a > 0 THEN (e - a) * LN(e / a) ELSE 0 END), 6) AS psi_profile FROM (
      SELECT (SELECT COUNT(*) FILTER (v BETWEEN q[i] AND q[i + 1]) / COUNT(*) FROM {b}) AS e,
             (SELECT COUNT(*) FILTER (v BETWEEN q[i] AND q[i + 1]) / COUNT(*) FROM {c}) AS a
      FROM (SELECT UNNEST(range(1, 11)) AS i), (SELECT QUANTILE_CONT(v, [{", ".join(str(i / 10) for i in range(11))}]) AS q FROM {b}))"""


@query("psi_profile", with_views(f"{psi_profile_sql(DRIFT_SIDES, 'o_totalprice')}", "drift_orders"))
def psi_profile(t):
    df = t.view("drift_orders")
    return r6(drift.psi_profile(df.filter("side = 'baseline'"), df.filter("side = 'target'"), ["o_totalprice"]))


@query("profile_drift_column", f"{psi_profile_sql(LINE_SIDES, 'l_discount')} UNION ALL {psi_profile_sql(LINE_SIDES, 'l_extendedprice')}")
def profile_drift_column(t):
    """The drift column of a profile taken against a stored baseline."""
    from plumbline.operators.score import profile

    df = t("lineitem").select("l_discount", "l_extendedprice", "l_shipdate")
    before = F.expr("l_shipdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    profiled = profile(df.filter(~before), as_of="2002-01-01 00:00:00", baseline=df.filter(before), rounded=False)
    return r6(profiled.filter("kind = 'numeric'").select("column_name", F.col("drift_psi").alias("psi_profile")))


@query(
    "psi_categorical",
    with_views(f"SELECT 'o_orderpriority' AS column_name, ROUND(psi, 6) AS psi, nb::BIGINT AS baseline_n, nt::BIGINT AS target_n FROM {chi2_sql(f'({DRIFT_SIDES})', 'o_orderpriority')}", "drift_orders"),
)
def psi_categorical(t):
    return r6(drift.psi_categorical(drift_sided(t), ["o_orderpriority"]))


def share_hist_sql(source: str, name: str) -> str:
    return f"""SELECT '{name}' AS column_name, ROUND((WITH c AS (
        SELECT COUNT(*) FILTER (b) / SUM(COUNT(*) FILTER (b)) OVER () AS s, COUNT(*) FILTER (NOT b) / SUM(COUNT(*) FILTER (NOT b)) OVER () AS r FROM ({source}) GROUP BY {name}),
      k AS (SELECT COUNT(*) AS k, list_sort(LIST(s)) AS x FROM c),
      ed AS (SELECT list_sort(list_distinct(list_transform(range(0, k + 1), lambda i:
          x[1 + FLOOR(i * (k - 1) / k)::INT] + (x[1 + CEIL(i * (k - 1) / k)::INT] - x[1 + FLOOR(i * (k - 1) / k)::INT]) * (i * (k - 1) / k - FLOOR(i * (k - 1) / k))))) AS e FROM k),
      h AS (SELECT LEAST(len(list_filter(e, lambda z: z <= s)), len(e) - 1) AS bin, 1 AS p, 0 AS q FROM c, ed WHERE s BETWEEN e[1] AND e[len(e)]
            UNION ALL SELECT LEAST(len(list_filter(e, lambda z: z <= r)), len(e) - 1), 0, 1 FROM c, ed WHERE r BETWEEN e[1] AND e[len(e)]),
      g AS (SELECT bin, SUM(p) AS p, SUM(q) AS q FROM h GROUP BY bin),
      f AS (SELECT COALESCE(NULLIF(p / ((SELECT SUM(p) FROM g) + 1e-8), 0), 1e-8) AS p, COALESCE(NULLIF(q / ((SELECT SUM(q) FROM g) + 1e-8), 0), 1e-8) AS q FROM g)
      SELECT SUM((p - q) * LN(p / q)) FROM f), 6) AS psi_share_hist"""


@query("psi_share_hist", f"{share_hist_sql(ORDER_SIDES, 'o_orderpriority')} UNION ALL {share_hist_sql(ORDER_SIDES, 'o_orderstatus')}")
def psi_share_hist(t):
    return r6(drift.psi_share_hist(orders_sided(t), ["o_orderpriority", "o_orderstatus"]))


def ks_row(source: str, name: str) -> str:
    return f"""SELECT '{name}' AS column_name, ROUND(d, 6) AS ks_stat, ROUND({KS_P}, 6) AS ks_p, n1::BIGINT AS baseline_n, n2::BIGINT AS target_n
      FROM (SELECT *, {LAM} AS lam FROM {ks_sql(side(source, name, True), side(source, name, False))})"""


@query("ks_two_sample", f"{ks_row(ORDER_SIDES, 'o_totalprice')} UNION ALL {ks_row(ORDER_SIDES, 'o_custkey')}")
def ks_two_sample(t):
    return r6(drift.ks_two_sample(orders_sided(t), ["o_totalprice", "o_custkey"]))


@query(
    "chi2_two_sample",
    f"""SELECT 'o_orderpriority' AS column_name, ROUND(chi2, 6) AS chi2, dof, ROUND({CHI2_P_EVEN}, 6) AS chi2_p FROM {chi2_sql(f'({ORDER_SIDES})', 'o_orderpriority')}
        UNION ALL SELECT 'o_orderstatus', ROUND(chi2, 6), dof, ROUND({CHI2_P_EVEN}, 6) FROM {chi2_sql(f'({ORDER_SIDES})', 'o_orderstatus')}""",
)
def chi2_two_sample(t):
    return r6(drift.chi2_two_sample(orders_sided(t), ["o_orderpriority", "o_orderstatus"]))


# ----------------------------------------------------------------------- population
def population_sql(source: str, numeric: str, textual: str) -> str:
    b, c = side(source, numeric, True), side(source, numeric, False)
    return f"""SELECT '{numeric}' AS column_name, 'numeric' AS type, ROUND(d, 6) AS ks_stat, ROUND({KS_P}, 6) AS ks_p, NULL::DOUBLE AS chi2, NULL::DOUBLE AS chi2_p,
        ROUND({psi_sql(b, c)}, 6) AS psi, n1::BIGINT AS baseline_n, n2::BIGINT AS target_n FROM (SELECT *, {LAM} AS lam FROM {ks_sql(b, c)})
      UNION ALL SELECT '{textual}', 'categorical', NULL, NULL, ROUND(chi2, 6), ROUND({CHI2_P_EVEN}, 6), ROUND(psi, 6), nb::BIGINT, nt::BIGINT FROM {chi2_sql(f'({source})', textual)}"""


RECORD = ["column_name", "type", "ks_stat", "ks_p", "chi2", "chi2_p", "psi", "baseline_n", "target_n"]


@query("drift_population", with_views(population_sql(DRIFT_SIDES, "o_totalprice", "o_orderpriority"), "drift_orders"))
def drift_population(t):
    return r6(drift.drift_population(drift_sided(t), ["o_totalprice", "o_orderpriority"]).select(*RECORD))


@query(
    "drift_population_share_hist",
    with_views(
        f"""SELECT r.*, h.psi_share_hist FROM ({population_sql(DRIFT_SIDES, "o_totalprice", "o_orderpriority")}) r
        LEFT JOIN ({share_hist_sql(DRIFT_SIDES, "o_orderpriority")}) h USING (column_name)""",
        "drift_orders",
    ),
)
def drift_population_share_hist(t):
    found = drift.drift_population(drift_sided(t), ["o_totalprice", "o_orderpriority"], share_hist=True)
    return r6(found.select(*RECORD, "psi_share_hist"))


@query("split_by_filter", f"SELECT b AS in_base, NOT b AS in_target, COUNT(*) AS n FROM ({ORDER_SIDES}) GROUP BY ALL")
def split_by_filter(t):
    return orders_sided(t).groupBy("in_base", "in_target").agg(F.count("*").alias("n"))


@query(
    "split_by_time",
    """SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) <= GREATEST(1, FLOOR(0.7 * (SELECT COUNT(*) FROM orders))) AS in_base FROM orders""",
)
def split_by_time(t):
    return drift.split_by_time(t("orders"), "o_orderdate", "o_orderkey").select("o_orderkey", "in_base")


@query("split_random")
def split_random(t):
    return drift.split_random(t("orders"), "o_orderkey").groupBy("in_base", "in_target").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------------- temporal
MONTHS = "mo AS (SELECT p, LAG(p) OVER (ORDER BY p) AS before FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS p FROM orders))"


def numeric_series(name: str) -> str:
    """PSI of each month against the one before, all months in one pass."""
    deciles = ", ".join(str(i / 10) for i in range(11))
    return f"""v AS (SELECT strftime(o_orderdate, '%Y-%m') AS p, {name}::DOUBLE AS v FROM orders WHERE {name} IS NOT NULL),
  q AS (SELECT p, QUANTILE_CONT(v, [{deciles}]) AS q FROM v GROUP BY p),
  ed AS (SELECT p, CASE WHEN len(list_distinct(q)) > 2 THEN list_sort(list_distinct(q)) ELSE list_transform(range(0, 11), lambda i: q[1] + (q[11] - q[1]) / 10.0 * i) END AS e FROM q),
  roles AS (SELECT mo.p AS pair, v.v, e, 1 AS b, 0 AS a FROM mo JOIN ed ON ed.p = mo.before JOIN v ON v.p = mo.before
            UNION ALL SELECT mo.p, v.v, e, 0, 1 FROM mo JOIN ed ON ed.p = mo.before JOIN v ON v.p = mo.p),
  h AS (SELECT pair, LEAST(len(list_filter(e, lambda x: x <= v)), len(e) - 1) AS k, SUM(b) AS b, SUM(a) AS a FROM roles WHERE v BETWEEN e[1] AND e[len(e)] GROUP BY ALL),
  sh AS (SELECT pair, COALESCE(NULLIF(b / (SUM(b) OVER (PARTITION BY pair) + 1e-8), 0), 1e-8) AS x, COALESCE(NULLIF(a / (SUM(a) OVER (PARTITION BY pair) + 1e-8), 0), 1e-8) AS y FROM h),
  nums AS (SELECT '{name}' AS column_name, pair AS period, SUM((x - y) * LN(x / y)) AS psi FROM sh GROUP BY pair)"""


def category_series(name: str) -> str:
    return f"""c AS (SELECT strftime(o_orderdate, '%Y-%m') AS p, {name} AS v, COUNT(*) AS n FROM orders WHERE {name} IS NOT NULL GROUP BY ALL),
  lv AS (SELECT DISTINCT v FROM c),
  cells AS (SELECT mo.p AS pair, lv.v, COALESCE(x.n, 0) AS b, COALESCE(y.n, 0) AS a FROM mo CROSS JOIN lv LEFT JOIN c x ON x.p = mo.before AND x.v = lv.v LEFT JOIN c y ON y.p = mo.p AND y.v = lv.v WHERE mo.before IS NOT NULL),
  cs AS (SELECT pair, COALESCE(NULLIF(b / (SUM(b) OVER (PARTITION BY pair) + 1e-8), 0), 1e-8) AS x, COALESCE(NULLIF(a / (SUM(a) OVER (PARTITION BY pair) + 1e-8), 0), 1e-8) AS y FROM cells WHERE a + b > 0),
  cats AS (SELECT '{name}' AS column_name, pair AS period, SUM((x - y) * LN(x / y)) AS psi FROM cs GROUP BY pair)"""


SERIES_SQL = f"WITH {MONTHS}, {numeric_series('o_totalprice')}, {category_series('o_orderpriority')}, s AS (SELECT * FROM nums UNION ALL SELECT * FROM cats)"


@query(
    "drift_temporal",
    f"""{SERIES_SQL} SELECT column_name, 'temporal' AS type, 'psi_over_time' AS metric, ROUND(AVG(psi), 6) AS avg_psi, ROUND(MAX(psi), 6) AS max_psi, COUNT(*) AS periods_analyzed FROM s GROUP BY column_name""",
)
def drift_temporal(t):
    return r6(drift.drift_temporal(t("orders"), "o_orderdate", ["o_totalprice", "o_orderpriority"]))


@query("chart_psi_series", f"{SERIES_SQL} SELECT column_name, period, ROUND(psi, 6) AS psi FROM s")
def chart_psi_series(t):
    return r6(drift.psi_series(t("orders"), "o_orderdate", ["o_totalprice", "o_orderpriority"]))


@query("drift_temporal_fallback")
def drift_temporal_fallback(t):
    """events cover one month: the seeded 70/30 population drift is taken."""
    return r6(drift.drift_over_time(t("events"), "ts", ["value", "event_type"], "event_id"))


# -------------------------------------------------------------------------- segment
def segment_branch(group: str, table: str = "orders", by: str = "o_orderstatus", number: str = "o_totalprice", level: str = "o_orderpriority") -> str:
    flag = f"SELECT *, {by}::VARCHAR = '{group}' AS b FROM {table}"
    b, c = side(flag, number, True), side(flag, number, False)
    return f"""SELECT '{number}' AS column_name, '{group}' AS segment, 'numeric_segment' AS type, ROUND(d, 6) AS ks_stat, ROUND({KS_P}, 6) AS ks_p, NULL::DOUBLE AS chi2, NULL::DOUBLE AS chi2_p,
        ROUND({psi_sql(b, c)}, 6) AS psi, n1::BIGINT AS baseline_n, n2::BIGINT AS target_n FROM (SELECT *, {LAM} AS lam FROM {ks_sql(b, c)})
      UNION ALL SELECT '{level}', '{group}', 'categorical_segment', NULL, NULL, ROUND(chi2, 6), ROUND({CHI2_P_EVEN}, 6), ROUND(psi, 6), nb::BIGINT, nt::BIGINT FROM {chi2_sql(f'({flag})', level)}"""


@query("drift_segment", "\nUNION ALL ".join(segment_branch(g) for g in ("F", "O", "P")))
def drift_segment(t):
    found = drift.drift_segment(t("orders"), "o_orderstatus", ["o_totalprice", "o_orderpriority"])
    return r6(found.drop("dof"))


@query(
    "drift_segment_top_groups",
    "SELECT c_nationkey::VARCHAR AS segment, COUNT(*) AS rows FROM customer GROUP BY 1 ORDER BY rows DESC, segment LIMIT 12",
)
def drift_segment_top_groups(t):
    return drift.top_groups(t("customer"), "c_nationkey")


@query("drift_segment_nations", "\nUNION ALL ".join(segment_branch(str(n), "customer", "c_nationkey", "c_acctbal", "c_mktsegment") for n in range(25)))
def drift_segment_nations(t):
    """All 25 groups."""
    return r6(drift.drift_segment(t("customer"), "c_nationkey", ["c_acctbal", "c_mktsegment"]).drop("dof"))


# -------------------------------------------------------------------- flags, summary
@query(
    "drift_auto_columns",
    """SELECT column_name FROM (SELECT ROW_NUMBER() OVER () AS i, column_name, data_type FROM (SELECT UNNEST(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderpriority']) AS column_name,
       UNNEST([typeof(ANY_VALUE(o_orderkey)), typeof(ANY_VALUE(o_custkey)), typeof(ANY_VALUE(o_orderstatus)), typeof(ANY_VALUE(o_totalprice)), typeof(ANY_VALUE(o_orderpriority))]) AS data_type FROM orders))
       WHERE data_type IN ('BIGINT', 'DOUBLE', 'INTEGER') ORDER BY i LIMIT 2""",
)
def drift_auto_columns(t):
    """The columns a drift run picks by itself, taken from its records."""
    return drift.drift_population(orders_sided(t)).select("column_name")


FLAGGED = f"SELECT column_name, psi, ks_p, chi2_p, COALESCE(psi > 0.2, FALSE) OR COALESCE(ks_p < 0.05, FALSE) OR COALESCE(chi2_p < 0.05, FALSE) AS flagged FROM ({population_sql(DRIFT_SIDES, 'o_totalprice', 'o_orderpriority')})"


@query("drift_flags", with_views(f"SELECT column_name, psi, flagged FROM ({FLAGGED})", "drift_orders"))
def drift_flags(t):
    records = drift.with_flags(drift.drift_population(drift_sided(t), ["o_totalprice", "o_orderpriority"]))
    return r6(records.select("column_name", "psi", "flagged"))


@query(
    "drift_summary",
    with_views(f"SELECT COUNT(*) AS n_records, COUNT(*) FILTER (flagged) AS n_flagged, COALESCE(STRING_AGG(column_name, ', ' ORDER BY column_name) FILTER (flagged), '') AS flagged_columns FROM ({FLAGGED})", "drift_orders"),
)
def drift_summary(t):
    records = drift.with_flags(drift.drift_population(drift_sided(t), ["o_totalprice", "o_orderpriority"]))
    return drift.drift_summary(records)
