"""Column profiles, scores, outliers and relationships."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import outliers, relations, score, stats
from plumbline.operators.drift import split_by_filter
from plumbline.plans.profile_sql import DIRTY_ORDERS, EVENTS, LINEITEM, ORDERS, metrics, per_column, profile_ctes
from plumbline.plans.registry import query, r6
from plumbline.sources.views import with_views

AS_OF = "2002-01-01 00:00:00"
BEFORE_98 = "o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'"
SQL_BEFORE_98 = "o_orderdate < TIMESTAMP '1998-01-01'"


def over_dirty(select: str) -> str:
    """A SELECT over the raw metrics ``m`` of dirty_orders."""
    return with_views(f"WITH m AS ({metrics('dirty_orders', DIRTY_ORDERS)}) {select}", "dirty_orders")


def over_lineitem(select: str) -> str:
    return f"WITH m AS ({metrics('lineitem', LINEITEM)}) {select}"


DIRTY_PROFILE = profile_ctes("dirty_orders", DIRTY_ORDERS, AS_OF, "o_orderkey")


def over_dirty_profile(select: str) -> str:
    return with_views(f"WITH {DIRTY_PROFILE} {select}", "dirty_orders")


def dirty_profile(t, rounded=False):
    return score.profile(t.view("dirty_orders"), as_of=AS_OF, order="o_orderkey", rounded=rounded)


# -------------------------------------------------------------------- profiling
@query("schema_profile", "\nUNION ALL ".join(
    f"SELECT '{n}' AS column_name, '{d}' AS type, '{ {'number': 'numeric', 'text': 'text', 'moment': 'datetime'}[c] }' AS kind, COUNT({n}) AS non_null FROM lineitem" for n, d, c in LINEITEM))
def schema_profile(t):
    return stats.schema_profile(t("lineitem")).drop("position")


@query(
    "basic_profile",
    f"""WITH m AS ({metrics('lineitem', LINEITEM)}),
vf AS ({per_column(LINEITEM, lambda n, d, c: f"SELECT '{n}' AS column_name, {n}::VARCHAR AS value, COUNT(*) AS n FROM lineitem GROUP BY {n}")}),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS k FROM vf),
top AS (SELECT column_name, STRING_AGG(value, ', ' ORDER BY k) AS top_values FROM r WHERE k <= 3 GROUP BY column_name)
SELECT column_name, type, ROUND(100.0 * (n - non_null) / n, 6) AS missing_pct, n_unique AS unique_values,
  ROUND(min, 9) AS min, ROUND(max, 9) AS max, ROUND(mean, 9) AS mean, top_values FROM m JOIN top USING (column_name)""",
)
def basic_profile(t):
    return r6(stats.basic_profile(t("lineitem")).drop("position"), 9)


@query(
    "dashboard_summary",
    over_dirty("SELECT column_name, type, ROUND(100.0 * (n - non_null) / n, 2) AS missing_pct, n_unique AS unique_values FROM m"),
)
def dashboard_summary(t):
    return stats.dashboard_summary(t.view("dirty_orders"))


@query(
    "top_missing_columns",
    over_dirty(
        "SELECT column_name, ROUND(100.0 * (n - non_null) / n, 6) AS missing_pct FROM m ORDER BY non_null, column_name LIMIT 3"
    ),
)
def top_missing_columns(t):
    return r6(stats.top_missing_columns(t.view("dirty_orders")))


@query(
    "advanced_stats",
    over_dirty(
        """SELECT column_name, type, ROUND(100.0 * (n - non_null) / n, 6) AS null_pct, n_unique AS unique_count, ROUND(mean, 6) AS mean,
           ROUND(std, 5) AS std, ROUND(min, 6) AS min, ROUND(max, 6) AS max, ROUND(100.0 * n_unique / n, 6) AS uniqueness_pct FROM m"""
    ),
)
def advanced_stats(t):
    found = stats.advanced_stats(t.view("dirty_orders"))
    return r6(found.withColumn("std", F.round("std", 5)))


@query(
    "date_stats",
    """SELECT 'l_shipdate' AS column_name, strftime(MAX(l_shipdate), '%Y-%m-%d %H:%M:%S') AS max_time, strftime(MIN(l_shipdate), '%Y-%m-%d %H:%M:%S') AS min_time,
       DATE_DIFF('day', MAX(l_shipdate), TIMESTAMP '2002-01-01') AS freshness_days FROM lineitem""",
)
def date_stats(t):
    found = stats.date_stats(t("lineitem"), AS_OF)
    text = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("max_time", "min_time")}
    return found.withColumns(text)


@query(
    "numeric_summary",
    with_views(
        per_column(
            [("o_totalprice", "", ""), ("o_orderpriority", "", ""), ("constant_one", "", "")],
            lambda n, d, c: f"""SELECT * FROM (SELECT '{n}' AS column_name, COUNT(v) AS n, ROUND(MIN(v), 6) AS min, ROUND(MAX(v), 6) AS max, ROUND(AVG(v), 6) AS mean,
              ROUND(STDDEV_SAMP(v), 5) AS std, COUNT(DISTINCT v) AS n_unique, ROUND(QUANTILE_CONT(v, 0.5), 6) AS median
              FROM (SELECT TRY_CAST({n} AS DOUBLE) AS v FROM dirty_orders)) WHERE n > 0""",
        ),
        "dirty_orders",
    ),
)
def numeric_summary(t):
    found = stats.numeric_summary(t.view("dirty_orders"), ["o_totalprice", "o_orderpriority", "constant_one"])
    return r6(found.withColumn("std", F.round("std", 5)))


@query(
    "completeness",
    over_dirty("SELECT column_name, n, non_null, ROUND(non_null / n, 6) AS completeness, ROUND(100 - 100 * non_null / n, 6) AS missing_pct FROM m"),
)
def completeness(t):
    return r6(stats.completeness(t.view("dirty_orders")))


@query("placeholder_ratio", over_dirty("SELECT column_name, ROUND(placeholder_ratio, 6) AS placeholder_ratio FROM m"))
def placeholder_ratio(t):
    return r6(stats.placeholder_ratio(t.view("dirty_orders")))


@query(
    "uniqueness",
    over_lineitem("SELECT column_name, n_unique, ROUND(n_unique / n, 6) AS uniqueness, ROUND(100 - 100 * n_unique / n, 6) AS duplicate_pct FROM m"),
)
def uniqueness(t):
    return r6(stats.uniqueness(t("lineitem")))


@query(
    "uniqueness_text",
    per_column(
        [("text", "", ""), ("lang", "", ""), ("source", "", "")],
        lambda n, d, c: f"SELECT '{n}' AS column_name, COUNT(DISTINCT {n}) AS n_unique, ROUND(COUNT(DISTINCT {n}) / COUNT(*), 6) AS uniqueness, ROUND(100 - 100 * COUNT(DISTINCT {n}) / COUNT(*), 6) AS duplicate_pct FROM documents",
    ),
)
def uniqueness_text(t):
    """Whole documents compared by digest."""
    return r6(stats.uniqueness(t("documents"), ["text", "lang", "source"]))


@query("entropy", over_lineitem("SELECT column_name, ROUND(entropy, 6) AS entropy FROM m"))
def entropy(t):
    return r6(stats.entropy(t("lineitem")))


@query("format_consistency", over_dirty("SELECT column_name, ROUND(format_consistency, 6) AS format_consistency FROM m"))
def format_consistency(t):
    return r6(stats.format_consistency(t.view("dirty_orders")))


@query(
    "format_pattern",
    """SELECT 'c_name' AS column_name, ROUND(AVG(CASE WHEN c_name SIMILAR TO 'Customer#[0-9]{9}' THEN 1.0 ELSE 0 END), 6) AS format_consistency FROM customer
       UNION ALL SELECT 'c_mktsegment', ROUND(AVG(CASE WHEN c_mktsegment SIMILAR TO 'Customer#[0-9]{9}' THEN 1.0 ELSE 0 END), 6) FROM customer""",
)
def format_pattern(t):
    return r6(stats.format_consistency(t("customer"), ["c_name", "c_mktsegment"], r"^Customer#[0-9]{9}$"))


@query(
    "range_conformity",
    with_views(
        """SELECT 'o_totalprice' AS column_name, ROUND(COUNT(*) FILTER (o_totalprice BETWEEN 0 AND 500000) / COUNT(o_totalprice), 6) AS range_conformity FROM dirty_orders
           UNION ALL SELECT 'o_custkey', ROUND(COUNT(*) FILTER (o_custkey >= 100) / COUNT(o_custkey), 6) FROM dirty_orders
           UNION ALL SELECT 'all_null', 1.0 UNION ALL SELECT 'o_orderpriority', 1.0""",
        "dirty_orders",
    ),
)
def range_conformity(t):
    bounds = {"o_totalprice": (0, 500000), "o_custkey": (100, None), "all_null": (0, 1), "o_orderpriority": (0, 1)}
    return r6(stats.range_conformity(t.view("dirty_orders"), bounds))


@query(
    "referential_integrity",
    with_views(
        """WITH good AS (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
           SELECT 'o_custkey' AS column_name, ROUND(AVG(CASE WHEN c_custkey IS NULL THEN 0.0 ELSE 1.0 END), 6) AS referential_integrity
           FROM dirty_orders LEFT JOIN good ON o_custkey = c_custkey WHERE o_custkey IS NOT NULL""",
        "dirty_orders",
    ),
)
def referential_integrity(t):
    """Against customers in good standing, through the profile."""
    good = t("customer").filter("c_acctbal >= 0")
    profiled = score.profile(
        t.view("dirty_orders").select("o_custkey"), as_of=AS_OF, references={"o_custkey": (good, "c_custkey")}, rounded=False
    )
    return r6(profiled.select("column_name", "referential_integrity"))


@query(
    "dtype_conformity",
    f"SELECT column_name, ROUND(CASE WHEN cls = 'moment' THEN non_null / n ELSE 1 END, 6) AS dtype_conformity FROM ({metrics('orders', ORDERS)})",
)
def dtype_conformity(t):
    return r6(stats.dtype_conformity(t("orders")))


@query("validity", over_dirty("SELECT column_name, ROUND((1 + format_consistency + 1 + 1) / 4, 6) AS validity FROM m"))
def validity(t):
    rates = stats.format_consistency(t.view("dirty_orders"))
    one = F.lit(1.0)
    whole = stats.validity(one, F.col("format_consistency"), one, F.lit(None).cast("double"))
    return r6(rates.select("column_name", whole.alias("validity")))


FLAGS_SQL = """SELECT column_name, n, n_unique,
  CASE WHEN regexp_matches(lower(column_name), '(id|code|number|_key|_no)$') AND n_unique >= 0.9 * n THEN TRUE
       ELSE n_unique = n AND type IN ('int','bigint','string') END AS is_id,
  regexp_matches(lower(column_name), '(id|code|number)$') AND n_unique = n AS is_id_v1,
  (column_name LIKE '%date%' OR column_name LIKE '%time%' OR column_name LIKE '%created%') OR (non_null > 0 AND parsed > 0.7 * non_null)
    OR COALESCE(mean > 1e10, FALSE) AS is_datetime FROM m"""


@query("detect_id_v2", f"WITH m AS ({metrics('events', EVENTS)}), flags AS ({FLAGS_SQL}) SELECT column_name, n, n_unique, is_id FROM flags")
def detect_id_v2(t):
    return stats.column_flags(t("events")).select("column_name", "n", "n_unique", "is_id")


@query("detect_id_v1", f"WITH m AS ({metrics('events', EVENTS)}), flags AS ({FLAGS_SQL}) SELECT column_name, n, n_unique, is_id_v1 FROM flags")
def detect_id_v1(t):
    return stats.column_flags(t("events")).select("column_name", "n", "n_unique", "is_id_v1")


@query("detect_datetime", over_dirty(f"SELECT column_name, is_datetime FROM ({FLAGS_SQL})"))
def detect_datetime(t):
    return stats.column_flags(t.view("dirty_orders")).select("column_name", "is_datetime")


@query("is_low_cardinality", over_lineitem("SELECT column_name, n_unique, n_unique <= 50 AND cls <> 'number' AS is_low_cardinality FROM m"))
def is_low_cardinality(t):
    return stats.low_cardinality(t("lineitem"))


@query(
    "mean_text_length",
    per_column([("text", "", ""), ("lang", "", ""), ("source", "", ""), ("doc_id", "", "")],
               lambda n, d, c: f"SELECT '{n}' AS column_name, ROUND(AVG(LENGTH({n}::VARCHAR)), 6) AS mean_length FROM documents"),
)
def mean_text_length(t):
    return r6(stats.mean_text_length(t("documents"), ["text", "lang", "source", "doc_id"]))


EXPLORED = [("l_quantity", "numeric"), ("l_extendedprice", "numeric"), ("l_discount", "numeric"), ("l_linenumber", "numeric"), ("l_returnflag", "text"), ("l_shipdate", "datetime")]


def explored(name: str, cls: str) -> str:
    """SQL of one row of the explorative profile."""
    number, text, moment = cls == "numeric", cls == "text", cls == "datetime"
    percent = ", ".join(f"{f'ROUND(QUANTILE_CONT(v, {p}), 9)' if number else 'NULL::DOUBLE'} AS p{int(p * 100):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95))
    top = f"FROM (SELECT {name}::VARCHAR AS x, COUNT(*) AS n FROM lineitem WHERE {name} IS NOT NULL GROUP BY 1 ORDER BY n DESC, x LIMIT 1)"
    if number:
        source = f"(SELECT {name} AS raw, {name}::DOUBLE AS v FROM lineitem), (SELECT AVG({name}) AS m, STDDEV_POP({name}) AS s FROM lineitem)"
    else:
        source = f"(SELECT {name} AS raw FROM lineitem)"
    shape = "ROUND(AVG(((v - m) / s) ** 3), 4) AS skewness, ROUND(AVG(((v - m) / s) ** 4) - 3, 4) AS kurtosis" if number else "NULL::DOUBLE AS skewness, NULL::DOUBLE AS kurtosis"
    return f"""SELECT '{name}' AS column_name, '{cls}' AS kind, COUNT(*) AS rows, COUNT(*) - COUNT(raw) AS missing, COUNT(DISTINCT raw) AS distinct_values,
      {'COUNT(*) FILTER (v = 0)' if number else 'NULL::BIGINT'} AS zeros, {'ROUND(AVG(v), 9)' if number else 'NULL::DOUBLE'} AS mean, {'ROUND(STDDEV_SAMP(v), 6)' if number else 'NULL::DOUBLE'} AS std,
      {shape}, {percent}, {'MIN(LENGTH(raw))::INT' if text else 'NULL::INT'} AS shortest, {'MAX(LENGTH(raw))::INT' if text else 'NULL::INT'} AS longest,
      {"strftime(MIN(raw), '%Y-%m-%d %H:%M:%S')" if moment else 'NULL::VARCHAR'} AS min_time, {"strftime(MAX(raw), '%Y-%m-%d %H:%M:%S')" if moment else 'NULL::VARCHAR'} AS max_time,
      {'NULL::VARCHAR' if number else f'(SELECT x {top})'} AS top_value, {'NULL::BIGINT' if number else f'(SELECT n {top})'} AS top_n,
      (SELECT COUNT(*) FROM lineitem) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicate_rows FROM {source}"""


@query("explorative_profile", "\nUNION ALL ".join(explored(n, c) for n, c in EXPLORED))
def explorative_profile(t):
    found = stats.explorative_profile(t("lineitem"), [n for n, _ in EXPLORED])
    digits = {"skewness": 4, "kurtosis": 4, "std": 6}
    text = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("min_time", "max_time")}
    return r6(found.withColumns({c: F.round(c, d) for c, d in digits.items()}).withColumns(text), 9)


@query(
    "duplicate_rows",
    """SELECT CAST(SUM(n) AS BIGINT) AS rows, COUNT(*) AS distinct_rows, CAST(SUM(n) - COUNT(*) AS BIGINT) AS duplicate_rows FROM
       (SELECT text, lang, source, n_chars, COUNT(*) AS n FROM documents GROUP BY ALL)""",
)
def duplicate_rows(t):
    return stats.duplicate_rows(t("documents"), ["text", "lang", "source", "n_chars"])


# ----------------------------------------------------------------------- scores
def full_row(prefix: str = "") -> str:
    return f"""SELECT column_name, type, is_id, is_datetime, ROUND(completeness, 6) AS completeness, ROUND(100 * placeholder_ratio, 6) AS placeholder_pct,
  ROUND(uniqueness, 6) AS uniqueness, ROUND(entropy, 6) AS entropy, ROUND(format_consistency, 6) AS format_consistency,
  ROUND(100 * outlier_z, 6) AS outlier_z_pct, ROUND(100 * outlier_iqr, 6) AS outlier_iqr_pct,
  ROUND(dq_score, 6) AS dq_score, dq_grade, ROUND(missing_pct, 6) AS missing_pct, ROUND(duplicate_pct, 6) AS duplicate_pct FROM {prefix}prof"""


PROFILE_ROW = [
    "column_name", "type", "is_id", "is_datetime", "completeness", "placeholder_pct", "uniqueness", "entropy",
    "format_consistency", "outlier_z_pct", "outlier_iqr_pct", "dq_score", "dq_grade", "missing_pct", "duplicate_pct",
]


@query("dq_profile", f"WITH {profile_ctes('lineitem', LINEITEM, AS_OF)} {full_row()}")
def dq_profile(t):
    return r6(score.profile(t("lineitem"), as_of=AS_OF, rounded=False).select(*PROFILE_ROW))


@query(
    "references_by_name",
    """WITH k AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)
       SELECT 'O_ORDERKEY' AS column_name, ROUND(COUNT(*) FILTER (l_orderkey IN (SELECT o_orderkey FROM k)) / COUNT(*), 6) AS referential_integrity FROM lineitem
       UNION ALL SELECT 'line_code', ROUND(COUNT(*) FILTER (l_linenumber IN (SELECT o_orderkey FROM k)) / COUNT(*), 6) FROM lineitem
       UNION ALL SELECT 'l_quantity', NULL FROM lineitem LIMIT 3""",
)
def references_by_name(t):
    known = t("orders").filter("o_orderkey % 3 <> 0").select("o_orderkey", "o_custkey")
    df = t("lineitem").selectExpr("l_orderkey AS O_ORDERKEY", "l_linenumber AS line_code", "l_quantity")
    found = score.profile(df, as_of=AS_OF, reference_tables={"orders": known}, rounded=False)
    return r6(found.select("column_name", "referential_integrity"))


@query(
    "format_consistency_compat",
    """SELECT 'large' AS column_name, ROUND(COUNT(*) FILTER (ABS(o_totalprice * 1e11) < 1e16) / COUNT(*), 6) AS format_consistency FROM orders
       UNION ALL SELECT 'o_orderkey', 1.0 UNION ALL SELECT 'o_orderpriority', ROUND(COUNT(*) FILTER (regexp_matches(o_orderpriority, '^[a-zA-Z0-9@.\\-_\\s]+$')) / COUNT(*), 6) FROM orders""",
)
def format_consistency_compat(t):
    df = t("orders").selectExpr("CAST(o_totalprice AS DOUBLE) * 1e11 AS large", "o_orderkey", "o_orderpriority")
    return r6(stats.format_consistency(df, compat=True))


@query("dq_profile_dirty", over_dirty_profile(full_row()))
def dq_profile_dirty(t):
    return r6(dirty_profile(t).select(*PROFILE_ROW))


@query("dq_profile_forest")
def dq_profile_forest(t):
    """The full profile with the isolation forest and a baseline for drift."""
    sided = split_by_filter(t("orders"), BEFORE_98)
    return score.profile(
        sided.filter("in_target").drop("in_base", "in_target"),
        as_of=AS_OF, order="o_orderkey", forest_key="o_orderkey",
        baseline=sided.filter("in_base").drop("in_base", "in_target"),
    )


@query("dq_score_column", over_dirty_profile("SELECT column_name, ROUND(dq_score, 6) AS dq_score FROM prof WHERE NOT is_id AND NOT is_datetime"))
def dq_score_column(t):
    return r6(dirty_profile(t).filter("NOT is_id AND NOT is_datetime").select("column_name", "dq_score"))


@query("dq_grade", over_dirty_profile("SELECT column_name, dq_grade FROM prof"))
def dq_grade(t):
    return dirty_profile(t).select("column_name", "dq_grade")


DATETIME_SQL = """SELECT column_name, n, parsed, ordered, ROUND(COALESCE(moment_score, 0), 6) AS dq_score,
  CASE WHEN moment_score IS NULL THEN 'Invalid Datetime' WHEN moment_score >= 90 THEN 'Fresh & Valid' WHEN moment_score >= 75 THEN 'Valid but Slightly Stale'
       WHEN moment_score >= 60 THEN 'Old / Semi-Valid' ELSE 'Invalid / Corrupted' END AS dq_grade FROM g"""
EVENTS_AS_OF = "2024-03-15 06:30:00"
EVENTS_TIME = [c for c in EVENTS if c[0] in ("ts", "event_type")]


@query("datetime_quality", f"WITH {profile_ctes('events', EVENTS_TIME, EVENTS_AS_OF, 'event_id').rsplit('prof AS', 1)[0].rstrip().rstrip(',')} "
       + DATETIME_SQL.replace("ordered,", "CASE WHEN parsed > 0 THEN ordered END AS ordered,"))
def datetime_quality(t):
    return r6(score.datetime_quality(t("events"), ["ts", "event_type"], "event_id", EVENTS_AS_OF))


@query(
    "datetime_quality_v1",
    """WITH a AS (SELECT COUNT(*) AS n, COUNT(ts) AS parsed, FLOOR(EPOCH(TIMESTAMP '2024-03-15 06:30:00' - MAX(ts)) / 86400) AS fresh, MIN(ts) AS lo, MAX(ts) AS hi FROM events),
       o AS (SELECT COUNT(*) FILTER (ts < p) = 0 OR COUNT(*) FILTER (ts > p) = 0 AS ordered FROM (SELECT ts, LAG(ts) OVER (ORDER BY event_id) AS p FROM events)),
       s AS (SELECT *, 20.0 * (parsed / n + 1 - CASE WHEN fresh <> 0 AND fresh < 365 THEN fresh / 365 ELSE 1 END + (lo > TIMESTAMP '1900-01-01')::INT
         + (hi < TIMESTAMP '2024-03-20 06:30:00')::INT + CASE WHEN ordered THEN 1 ELSE 0.8 END) AS q FROM a, o)
       SELECT 'ts' AS column_name, n, parsed, ordered, ROUND(LEAST(q, 100), 6) AS dq_score,
         CASE WHEN q >= 90 THEN 'Fresh & Valid' WHEN q >= 75 THEN 'Valid but Slightly Stale' WHEN q >= 60 THEN 'Old / Semi-Valid' ELSE 'Invalid / Corrupted' END AS dq_grade FROM s""",
)
def datetime_quality_v1(t):
    return r6(score.datetime_quality(t("events"), ["ts"], "event_id", EVENTS_AS_OF, variant="v1"))


@query(
    "datetime_grade",
    over_dirty_profile("SELECT column_name, dq_grade FROM prof WHERE is_datetime AND NOT is_id"),
)
def datetime_grade(t):
    return dirty_profile(t).filter("is_datetime AND NOT is_id").select("column_name", "dq_grade")


@query(
    "monotone_order",
    """WITH s AS (SELECT 'ts' AS column_name, ts AS d, LAG(ts) OVER (ORDER BY event_id) AS p FROM events)
       SELECT column_name, SUM((d < p)::INT) = 0 OR SUM((d > p)::INT) = 0 AS ordered FROM s GROUP BY column_name""",
)
def monotone_order(t):
    return score.monotone_order(t("events"), ["ts"], "event_id")


@query(
    "monotone_order_unsorted",
    """SELECT 'o_orderdate' AS column_name, COUNT(*) FILTER (d < p) = 0 OR COUNT(*) FILTER (d > p) = 0 AS ordered
       FROM (SELECT o_orderdate AS d, LAG(o_orderdate) OVER (ORDER BY o_orderkey) AS p FROM orders)""",
)
def monotone_order_unsorted(t):
    return score.monotone_order(t("orders"), ["o_orderdate"], "o_orderkey")


V1_SQL = """v AS (SELECT column_name, type, 100.0 * (n - non_null) / n AS null_pct, n_unique AS unique_count, 100.0 * n_unique / n AS uniqueness_pct,
  100 * outlier_z AS outlier_pct, regexp_matches(lower(column_name), '(id|code|number)$') AND n_unique = n AS is_id FROM m),
w AS (SELECT *, LEAST(100, 100 - CASE WHEN null_pct > 10 THEN 15 ELSE 0 END - CASE WHEN uniqueness_pct < 50 THEN 15 ELSE 0 END
  - CASE WHEN outlier_pct > 5 THEN 15 ELSE 0 END + CASE WHEN is_id THEN 5 ELSE 0 END)::DOUBLE AS dq_score FROM v)"""


@query(
    "dq_score_v1",
    over_dirty(f"SELECT column_name, ROUND(null_pct, 6) AS null_pct, ROUND(uniqueness_pct, 6) AS uniqueness_pct, ROUND(outlier_pct, 6) AS outlier_pct, is_id, dq_score FROM (WITH {V1_SQL} SELECT * FROM w)"),
)
def dq_score_v1(t):
    scored = score.score_v1(t.view("dirty_orders"))
    return r6(scored.select("column_name", "null_pct", "uniqueness_pct", "outlier_pct", "is_id", "dq_score"))


@query("dataset_score", over_dirty_profile("SELECT ROUND(AVG(dq_score), 6) AS dataset_score, COUNT(*) AS n_columns FROM prof"))
def dataset_score(t):
    return r6(score.dataset_score(dirty_profile(t)))


STALE_AS_OF = "2030-01-01 00:00:00"


@query(
    "bad_columns",
    f"WITH {profile_ctes('events', EVENTS, STALE_AS_OF, 'event_id')} SELECT column_name, ROUND(dq_score, 6) AS dq_score FROM prof WHERE dq_score < 60",
)
def bad_columns(t):
    """Events seen years later: the timestamps are too stale to pass."""
    profiled = score.profile(t("events"), as_of=STALE_AS_OF, order="event_id", rounded=False)
    return r6(score.bad_columns(profiled))


ISSUES = """COALESCE(NULLIF(CONCAT_WS('; ', CASE WHEN missing_pct > 10 THEN 'missing values' END, CASE WHEN placeholder_ratio > 0.05 THEN 'placeholder values' END,
  CASE WHEN format_consistency < 0.95 THEN 'format errors' END, CASE WHEN GREATEST(outlier_z, outlier_iqr) > 0.05 THEN 'outliers' END), ''), 'No major issues')"""


@query(
    "score_ranking",
    over_dirty_profile(f"SELECT CAST(ROW_NUMBER() OVER (ORDER BY ROUND(dq_score, 9), idx) AS INTEGER) AS place, column_name, ROUND(dq_score, 6) AS dq_score, {ISSUES} AS issues FROM prof JOIN (VALUES "
    + ", ".join(f"('{n}', {i})" for i, (n, _, _) in enumerate(DIRTY_ORDERS)) + ") o(cn, idx) ON cn = column_name"),
)
def score_ranking(t):
    return r6(score.score_ranking(r6(dirty_profile(t), 9)))


@query(
    "moderate_poor_report",
    over_dirty_profile(
        f"""SELECT 'weak' AS section, column_name AS item, CONCAT(dq_grade, ': ', {ISSUES}) AS detail FROM prof WHERE dq_grade IN ('Moderate', 'Poor')
        UNION ALL SELECT 'identifier', column_name, dq_grade FROM prof WHERE is_id
        UNION ALL SELECT 'datetime', column_name, dq_grade FROM prof WHERE is_datetime AND NOT is_id
        UNION ALL SELECT * FROM (SELECT 'issue', item, printf('%.4f', ROUND(size, 4)) FROM (
          SELECT 'missingness' AS item, AVG(missing_pct) AS size FROM prof UNION ALL SELECT 'outliers', AVG(100 * GREATEST(outlier_z, outlier_iqr)) FROM prof
          UNION ALL SELECT 'drift', 0 UNION ALL SELECT 'placeholders', AVG(100 * placeholder_ratio) FROM prof) ORDER BY size DESC, item LIMIT 3)"""
    ),
)
def moderate_poor_report(t):
    return score.quality_report(dirty_profile(t))


# --------------------------------------------------------------------- outliers
NUMERIC_DIRTY = ["o_totalprice", "o_custkey", "constant_one"]


def over_numeric(select: str) -> str:
    picked = [c for c in DIRTY_ORDERS if c[0] in NUMERIC_DIRTY]
    return with_views(f"WITH m AS ({metrics('dirty_orders', picked)}) {select}", "dirty_orders")


@query("outlier_zscore", over_numeric("SELECT column_name, non_null AS n, ROUND(outlier_z, 6) AS outlier_z FROM m"))
def outlier_zscore(t):
    return r6(outliers.zscore_rates(t.view("dirty_orders"), NUMERIC_DIRTY))


@query(
    "outlier_iqr",
    over_numeric(
        """SELECT column_name, non_null AS n, ROUND(q1, 6) AS q1, ROUND(q3, 6) AS q3, ROUND(outlier_iqr, 6) AS outlier_iqr FROM m JOIN (
        """ + per_column([(n, "", "") for n in NUMERIC_DIRTY], lambda n, d, c: f"SELECT '{n}' AS column_name, QUANTILE_CONT({n}::DOUBLE, 0.25) AS q1, QUANTILE_CONT({n}::DOUBLE, 0.75) AS q3 FROM dirty_orders") + ") USING (column_name)"
    ),
)
def outlier_iqr(t):
    return r6(outliers.iqr_rates(t.view("dirty_orders"), NUMERIC_DIRTY))


@query("outlier_iforest")
def outlier_iforest(t):
    return r6(outliers.forest_rates(t.view("dirty_orders"), ["o_totalprice", "o_custkey"], "o_orderkey"))


@query("outlier_iforest_5pct")
def outlier_iforest_5pct(t):
    return r6(outliers.forest_rates(t.view("dirty_orders"), ["o_totalprice", "o_custkey"], "o_orderkey", contamination=0.05))


# Two far clusters beside one value that nearly all rows have: every tree parts them from it first, so that exactly the
# planted rows score above 0.5.
PLANTED = "CASE WHEN o_orderkey % 97 = 0 THEN 1e6 + o_orderkey % 5 WHEN o_orderkey % 89 = 0 THEN -1e6 ELSE 100.0 END"


@query(
    "outlier_iforest_planted",
    f"""SELECT 'v' AS column_name, COUNT(*) AS n, ROUND(COUNT(*) FILTER (v <> 100) / COUNT(*), 6) AS outlier_iso FROM (SELECT {PLANTED} AS v FROM orders)""",
)
def outlier_iforest_planted(t):
    return r6(outliers.forest_rates(t("orders").select(F.expr(PLANTED).cast("double").alias("v")), ["v"]))


@query("outlier_combined")
def outlier_combined(t):
    return r6(outliers.combined_rates(t.view("dirty_orders"), ["o_totalprice", "o_custkey"], "o_orderkey"))


@query(
    "outlier_rows",
    with_views(
        """WITH q AS (SELECT QUANTILE_CONT(o_totalprice, 0.25) AS a, QUANTILE_CONT(o_totalprice, 0.75) AS b FROM dirty_orders)
           SELECT o_orderkey, o_totalprice FROM dirty_orders, q WHERE o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a)""",
        "dirty_orders",
    ),
)
def outlier_rows(t):
    return outliers.outlier_rows(t.view("dirty_orders"), "o_totalprice").select("o_orderkey", "o_totalprice")


# ---------------------------------------------------------------- relationships
NUMBERS = [n for n, _, c in LINEITEM if c == "number"]
CORR_SQL = "\nUNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, CORR({a}, {b}) AS corr FROM lineitem"
    for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1:]
)


@query("corr_matrix", f"SELECT col_a, col_b, ROUND(corr, 6) AS corr FROM ({CORR_SQL})")
def corr_matrix(t):
    return r6(relations.corr_matrix(t("lineitem"), NUMBERS))


@query(
    "high_corr_pairs",
    """SELECT 'p_partkey' AS col_a, 'p_retailprice' AS col_b, ROUND(c, 6) AS corr FROM (SELECT CORR(p_partkey, p_retailprice) AS c FROM part) WHERE ABS(c) > 0.9
       UNION ALL SELECT 'p_partkey', 'p_size', ROUND(c, 6) FROM (SELECT CORR(p_partkey, p_size) AS c FROM part) WHERE ABS(c) > 0.9
       UNION ALL SELECT 'p_size', 'p_retailprice', ROUND(c, 6) FROM (SELECT CORR(p_size, p_retailprice) AS c FROM part) WHERE ABS(c) > 0.9
       UNION ALL SELECT 'p_size', 'double_size', ROUND(c, 6) FROM (SELECT CORR(p_size, 2 * p_size + 1) AS c FROM part) WHERE ABS(c) > 0.9
       UNION ALL SELECT 'p_partkey', 'double_size', ROUND(c, 6) FROM (SELECT CORR(p_partkey, 2 * p_size + 1) AS c FROM part) WHERE ABS(c) > 0.9
       UNION ALL SELECT 'p_retailprice', 'double_size', ROUND(c, 6) FROM (SELECT CORR(p_retailprice, 2 * p_size + 1) AS c FROM part) WHERE ABS(c) > 0.9""",
)
def high_corr_pairs(t):
    return r6(relations.high_corr_pairs(t("part").withColumn("double_size", F.expr("2 * p_size + 1"))))


@query(
    "candidate_pairs",
    over_lineitem(
        "SELECT a.column_name AS col1, b.column_name AS col2 FROM (SELECT *, ROW_NUMBER() OVER () AS i FROM m) a JOIN (SELECT *, ROW_NUMBER() OVER () AS i FROM m) b ON a.i < b.i WHERE a.n_unique <= 50 AND b.n_unique <= 50"
    ),
)
def candidate_pairs(t):
    return relations.candidate_pairs(t("lineitem"))


def fd_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS col1, '{b}' AS col2, key, COUNT(*) AS n_distinct, CAST(SUM(n) AS BIGINT) AS rows, MAX(n) / SUM(n) AS mode_share
      FROM (SELECT {a}::VARCHAR AS key, {b} AS v, COUNT(*) AS n FROM fd_customer_nation WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL) GROUP BY key HAVING COUNT(*) > 1"""


FD_PAIR = [("c_nationkey", "n_name")]


@query(
    "fd_consistency",
    with_views(f"SELECT col1, col2, key, n_distinct, rows, ROUND(mode_share, 6) AS mode_share FROM ({fd_sql('c_nationkey', 'n_name')})", "fd_customer_nation"),
)
def fd_consistency(t):
    return r6(relations.fd_consistency(t.view("fd_customer_nation"), FD_PAIR))


@query(
    "cross_relation_report",
    with_views(
        f"""SELECT col1, col2, COUNT(*) AS inconsistent_keys, MAX(n_distinct) AS max_distinct, CAST(SUM(rows) AS BIGINT) AS rows, ROUND(MIN(mode_share), 6) AS min_mode_share
        FROM ({fd_sql('c_nationkey', 'n_name')} UNION ALL {fd_sql('n_name', 'c_nationkey')}) GROUP BY col1, col2""",
        "fd_customer_nation",
    ),
)
def cross_relation_report(t):
    return r6(relations.cross_relation_report(t.view("fd_customer_nation"), FD_PAIR))


def cramers_sql(source: str, a: str, b: str) -> str:
    return f"""SELECT '{a}' AS col1, '{b}' AS col2, ROUND(CASE WHEN r < 2 OR k < 2 THEN 0 ELSE SQRT(GREATEST(0, chi / n - (k - 1) * (r - 1) / (n - 1))
      / (LEAST(k - (k - 1) ** 2 / (n - 1), r - (r - 1) ** 2 / (n - 1)) - 1)) END, 6) AS cramers_v FROM (
      SELECT SUM((o - rt * ct / n) ** 2 / (rt * ct / n)) AS chi, ANY_VALUE(n) AS n, COUNT(DISTINCT x) AS r, COUNT(DISTINCT y) AS k FROM (
        SELECT rr.x, cc.y, COALESCE(o, 0) AS o, rt, ct, n FROM
          (SELECT COALESCE({a}::VARCHAR, '__NA__') AS x, COUNT(*)::DOUBLE AS rt FROM {source} GROUP BY 1) rr CROSS JOIN
          (SELECT COALESCE({b}::VARCHAR, '__NA__') AS y, COUNT(*)::DOUBLE AS ct FROM {source} GROUP BY 1) cc CROSS JOIN (SELECT COUNT(*)::DOUBLE AS n FROM {source}) LEFT JOIN
          (SELECT COALESCE({a}::VARCHAR, '__NA__') AS x, COALESCE({b}::VARCHAR, '__NA__') AS y, COUNT(*) AS o FROM {source} GROUP BY 1, 2) t ON t.x = rr.x AND t.y = cc.y))"""


@query("cramers_v", with_views(cramers_sql("fd_customer_nation", "c_nationkey", "n_name"), "fd_customer_nation"))
def cramers_v(t):
    return r6(relations.cramers_v(t.view("fd_customer_nation"), FD_PAIR))


@query("cramers_v_pairs", cramers_sql("lineitem", "l_returnflag", "l_linestatus") + " UNION ALL " + cramers_sql("lineitem", "l_discount", "l_tax"))
def cramers_v_pairs(t):
    return r6(relations.cramers_v(t("lineitem"), [("l_returnflag", "l_linestatus"), ("l_discount", "l_tax")]))


def mode_share_sql(source: str, a: str, b: str) -> str:
    return f"""SELECT '{a}' AS col1, '{b}' AS col2, AVG(s) AS mode_share, COUNT(*) AS n_keys FROM (SELECT MAX(n) / SUM(n) AS s FROM
      (SELECT {a} AS x, {b} AS y, COUNT(*) AS n FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL) GROUP BY x)"""


@query(
    "conditional_mode_share",
    with_views(f"SELECT col1, col2, ROUND(mode_share, 6) AS mode_share, n_keys FROM ({mode_share_sql('fd_customer_nation', 'c_nationkey', 'n_name')})", "fd_customer_nation"),
)
def conditional_mode_share(t):
    return r6(relations.conditional_mode_share(t.view("fd_customer_nation"), FD_PAIR))


@query(
    "statistical_signals",
    f"""SELECT 'l_returnflag' AS column_name, ROUND(AVG(mode_share), 6) AS avg_mode_share, MAX(cramers_v) AS max_cramers_v FROM
      ({mode_share_sql('lineitem', 'l_linestatus', 'l_returnflag')} UNION ALL {mode_share_sql('lineitem', 'l_tax', 'l_returnflag')}) JOIN
      ({cramers_sql('lineitem', 'l_linestatus', 'l_returnflag')} UNION ALL {cramers_sql('lineitem', 'l_tax', 'l_returnflag')}) USING (col1, col2)""",
)
def statistical_signals(t):
    return r6(relations.statistical_signals(t("lineitem"), {"l_returnflag": ["l_linestatus", "l_tax"]}))


@query(
    "select_candidates",
    over_lineitem(
        """SELECT column_name, regexp_matches(column_name, 'id|code|type|category|status|class|segment') AS by_name, n_unique FROM m
           WHERE regexp_matches(column_name, 'id|code|type|category|status|class|segment') OR n_unique <= 50 OR cls = 'number'"""
    ),
)
def select_candidates(t):
    return relations.select_candidates(t("lineitem"))


@query(
    "rank_context_columns",
    """WITH c AS (SELECT 'p_partkey' AS column_name, 0 AS i, AVG(LENGTH(p_partkey::VARCHAR)) AS len, COUNT(DISTINCT p_partkey) AS u FROM part
         UNION ALL SELECT 'p_name', 1, AVG(LENGTH(p_name)), COUNT(DISTINCT p_name) FROM part
         UNION ALL SELECT 'p_type', 3, AVG(LENGTH(p_type)), COUNT(DISTINCT p_type) FROM part
         UNION ALL SELECT 'p_size', 4, AVG(LENGTH(p_size::VARCHAR)), COUNT(DISTINCT p_size) FROM part
         UNION ALL SELECT 'p_retailprice', 5, AVG(LENGTH(p_retailprice::VARCHAR)), COUNT(DISTINCT p_retailprice) FROM part),
       s AS (SELECT *, CASE WHEN regexp_matches(column_name, 'name|title|desc|label|product|fund') THEN 2.0 ELSE 0 END + CASE WHEN len > 5 THEN 1.0 ELSE 0 END + CASE WHEN u > 1 THEN 0.5 ELSE 0 END AS score FROM c)
       SELECT column_name, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0 ORDER BY score DESC, i LIMIT 3""",
)
def rank_context_columns(t):
    return relations.rank_context_columns(t("part"), "p_brand")

