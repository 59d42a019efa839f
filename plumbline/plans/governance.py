"""Governance rules, checks and remediation."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import checks, relations, rules, score, stats
from plumbline.plans.profiles import (
    AS_OF,
    V1_SQL,
    dirty_profile,
    over_dirty,
    over_dirty_profile,
)
from plumbline.plans.profile_sql import LINEITEM, metrics, profile_ctes
from plumbline.plans.registry import query, r6
from plumbline.sources.views import with_views

# ------------------------------------------------------------------ derived rules
WORD = "list_has_any(string_split(lower(column_name), '_'), [{}])"
AGE, PERCENT = WORD.format("'age'"), WORD.format("'percent','pct','rate'")
HEURISTIC = f"""SELECT column_name, 'primary_key' AS rule_type, 'High' AS severity, 'High' AS confidence FROM prof WHERE is_id
  UNION ALL SELECT column_name, 'stability', 'Medium', 'Medium' FROM prof WHERE is_id
  UNION ALL SELECT column_name, 'datetime_validity', IF(missing_pct > 20, 'High', 'Medium'), 'High' FROM prof WHERE is_datetime AND NOT is_id
  UNION ALL SELECT column_name, 'staleness', IF(dq_score < 75, 'High', 'Medium'), 'Medium' FROM prof WHERE is_datetime AND NOT is_id
  UNION ALL SELECT column_name, 'domain_constraint', 'Medium', 'Medium' FROM prof WHERE NOT is_id AND NOT is_datetime AND cls = 'text'
  UNION ALL SELECT column_name, 'text_standardization', 'Medium', 'Medium' FROM prof WHERE NOT is_id AND NOT is_datetime AND cls = 'text' AND duplicate_pct > 80
  UNION ALL SELECT column_name, 'business_range', 'High', 'High' FROM prof WHERE NOT is_id AND NOT is_datetime AND cls = 'number' AND {AGE}
  UNION ALL SELECT column_name, 'percentage_range', 'Medium', 'High' FROM prof WHERE NOT is_id AND NOT is_datetime AND cls = 'number' AND {PERCENT}
  UNION ALL SELECT column_name, 'non_negative', 'Medium', 'High' FROM prof WHERE NOT is_id AND NOT is_datetime AND cls = 'number' AND (column_name LIKE '%price')
  UNION ALL SELECT column_name, 'missing_values', 'High', 'High' FROM prof WHERE NOT is_id AND NOT is_datetime AND missing_pct > 10"""


@query("rules_heuristic", over_dirty_profile(HEURISTIC))
def rules_heuristic(t):
    found = rules.rules_heuristic(dirty_profile(t))
    return found.select("column_name", "rule_type", "severity", "confidence")


LINE_PROFILE = profile_ctes("lineitem", LINEITEM, AS_OF)


@query(
    "rules_heuristic_text",
    f"""WITH {LINE_PROFILE}
  SELECT column_name, column_name || ' should be refreshed at least once every 90 days for operational recency.' AS rule,
    'SELECT * FROM <TABLE> WHERE `' || column_name || '` < current_date() - INTERVAL 90 DAYS' AS enforcement_sql FROM prof WHERE is_datetime AND NOT is_id
  UNION ALL SELECT column_name, 'Values in ' || column_name || ' should conform to a known taxonomy or reference table when available.',
    'SELECT t.* FROM <TABLE> t LEFT ANTI JOIN <REF_TABLE> r ON t.`' || column_name || '` = r.`<REF_COL>`' FROM prof WHERE cls = 'text'""",
)
def rules_heuristic_text(t):
    found = rules.rules_heuristic(score.profile(t("lineitem"), as_of=AS_OF, rounded=False))
    return found.filter(F.col("rule_type").isin("staleness", "domain_constraint")).select(
        "column_name", "rule", "enforcement_sql"
    )


@query(
    "rules_basic",
    over_dirty(
        f"""SELECT column_name, type, COALESCE((SELECT STRING_AGG(r, ' ') FROM (VALUES (1, CASE WHEN is_id THEN 'Must be unique (Primary Key). Must not contain null values. Should be stable (no drift across datasets).' END),
          (2, CASE WHEN NOT is_id AND cls = 'number' THEN 'Enforce numeric range: [' || COALESCE(min::DECIMAL(30,2)::VARCHAR, 'null') || ', ' || COALESCE(max::DECIMAL(30,2)::VARCHAR, 'null') || '].' END),
          (3, CASE WHEN NOT is_id AND cls = 'number' AND outlier_pct > 5 THEN 'Flag high-outlier records for manual review.' END),
          (4, CASE WHEN NOT is_id AND cls = 'number' AND null_pct > 0 THEN 'Impute or drop null values.' END),
          (5, CASE WHEN NOT is_id AND cls = 'text' THEN 'Restrict values to observed categories or a reference taxonomy.' END),
          (6, CASE WHEN NOT is_id AND cls = 'text' AND null_pct > 0 THEN 'Fill nulls with mode or ''Unknown''.' END),
          (7, CASE WHEN NOT is_id AND cls = 'text' AND unique_count > 50 THEN 'Review for free-text values; consider standardization.' END),
          (8, CASE WHEN cls = 'text' AND unique_count > 1000 THEN 'Enforce max length for text values (e.g., 255 chars).' END)) x(i, r) WHERE r IS NOT NULL), '') AS rules
        FROM (WITH {V1_SQL} SELECT w.*, m.cls, m.min, m.max FROM w JOIN m USING (column_name))"""
    ),
)
def rules_basic(t):
    scored = score.score_v1(t.view("dirty_orders")).withColumn("freshness_days", stats.whole_days(AS_OF, F.col("max_time")))
    return rules.rules_basic(scored).select("column_name", "type", F.array_join("rules", " ").alias("rules"))


@query(
    "dataset_rules",
    over_dirty_profile(
        """SELECT ROUND(s, 6) AS dataset_score, CASE WHEN s < 60 THEN 'Dataset DQ score < 60: trigger full remediation workflow.'
           WHEN s < 75 THEN 'Dataset DQ score 60-75: schedule monitoring and targeted fixes.' ELSE 'Dataset DQ score >= 75: continue monitoring critical rules.' END AS rule
           FROM (SELECT AVG(dq_score) AS s FROM prof)"""
    ),
)
def dataset_rules(t):
    return r6(rules.dataset_rules(score.dataset_score(dirty_profile(t))))


PART_COLUMNS = [("p_partkey", "bigint", "number"), ("p_size", "int", "number"), ("p_retailprice", "double", "number")]


@query(
    "dataset_rules_v1",
    f"""WITH m AS ({metrics('part', PART_COLUMNS)}), {V1_SQL}
      SELECT 'Dataset DQ score below threshold: initiate cleansing workflow.' AS rule FROM w HAVING AVG(dq_score) < 80
      UNION ALL SELECT 'High correlation detected: ' || STRING_AGG(note, ', ' ORDER BY note) FROM (
        SELECT 'p_partkey ~ p_retailprice (corr=' || printf('%.2f', CORR(p_partkey, p_retailprice)) || ')' AS note FROM part HAVING ABS(CORR(p_partkey, p_retailprice)) > 0.9
        UNION ALL SELECT 'p_partkey ~ p_size (corr=' || printf('%.2f', CORR(p_partkey, p_size)) || ')' FROM part HAVING ABS(CORR(p_partkey, p_size)) > 0.9
        UNION ALL SELECT 'p_size ~ twice (corr=' || printf('%.2f', CORR(p_size, 2 * p_size)) || ')' FROM part HAVING ABS(CORR(p_size, 2 * p_size)) > 0.9) HAVING COUNT(*) > 0""",
)
def dataset_rules_v1(t):
    df = t("part").select("p_partkey", "p_size", "p_retailprice")
    pairs = relations.high_corr_pairs(df.withColumn("twice", 2 * F.col("p_size")))
    return rules.dataset_rules_v1(score.dataset_score(score.score_v1(df)), pairs)


# ------------------------------------------------------------------------- checks
def check(name: str, sql: str, *views: str):
    return query(name, with_views(sql, *views) if views else sql)


@check("check_not_null", "SELECT o_orderkey FROM dirty_orders WHERE o_custkey IS NULL", "dirty_orders")
def check_not_null(t):
    return checks.check_not_null(t.view("dirty_orders"), "o_custkey").select("o_orderkey")


@check(
    "check_missing_count",
    "SELECT 'o_custkey' AS column_name, COUNT(*) - COUNT(o_custkey) AS missing FROM dirty_orders UNION ALL SELECT 'all_null', COUNT(*) - COUNT(all_null) FROM dirty_orders UNION ALL SELECT 'constant_one', COUNT(*) - COUNT(constant_one) FROM dirty_orders",
    "dirty_orders",
)
def check_missing_count(t):
    return checks.check_missing_count(t.view("dirty_orders"), ["o_custkey", "all_null", "constant_one"])


@check("check_unique", "SELECT l_orderkey AS value, COUNT(*) AS n FROM lineitem GROUP BY 1 HAVING COUNT(*) > 1")
def check_unique(t):
    return checks.check_unique(t("lineitem"), "l_orderkey")


@check("check_range", "SELECT o_orderkey, o_totalprice FROM dirty_orders WHERE o_totalprice < 5000 OR o_totalprice > 500000", "dirty_orders")
def check_range(t):
    return checks.check_range(t.view("dirty_orders"), "o_totalprice", 5000, 500000).select("o_orderkey", "o_totalprice")


@check("check_non_negative", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")
def check_non_negative(t):
    return checks.check_range(t("customer"), "c_acctbal", low=0).select("c_custkey", "c_acctbal")


@check("check_regex", "SELECT o_orderkey, o_orderpriority FROM dirty_orders WHERE NOT (o_orderpriority SIMILAR TO '[1-5]-[A-Z ]+')", "dirty_orders")
def check_regex(t):
    return checks.check_regex(t.view("dirty_orders"), "o_orderpriority", r"^[1-5]-[A-Z ]+$").select("o_orderkey", "o_orderpriority")


@check(
    "check_fk",
    "SELECT o_orderkey, o_custkey FROM dirty_orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)",
    "dirty_orders",
)
def check_fk(t):
    good = t("customer").filter("c_acctbal >= 0")
    return checks.check_fk(t.view("dirty_orders"), "o_custkey", good, "c_custkey").select("o_orderkey", "o_custkey")


@check("check_staleness", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-06-01' - INTERVAL 90 DAY")
def check_staleness(t):
    return checks.check_staleness(t("lineitem"), "l_shipdate", "2001-06-01 00:00:00").select("l_orderkey", "l_partkey")


@check("check_datetime_parse", "SELECT o_orderkey, o_orderdate_txt FROM dirty_orders WHERE TRY_CAST(o_orderdate_txt AS DATE) IS NULL", "dirty_orders")
def check_datetime_parse(t):
    return checks.check_datetime_parse(t.view("dirty_orders"), "o_orderdate_txt").select("o_orderkey", "o_orderdate_txt")


@check(
    "check_taxonomy",
    "SELECT o_orderpriority AS value, COUNT(*) AS n FROM dirty_orders WHERE o_orderpriority NOT IN (SELECT DISTINCT o_orderpriority FROM orders) GROUP BY 1",
    "dirty_orders",
)
def check_taxonomy(t):
    known = t("orders").select("o_orderpriority").distinct()
    return checks.check_taxonomy(t.view("dirty_orders"), "o_orderpriority", known, "o_orderpriority")


@check("check_max_length", "SELECT doc_id, LENGTH(text) AS length FROM documents WHERE LENGTH(text) > 255")
def check_max_length(t):
    return checks.check_max_length(t("documents"), "text").select("doc_id", F.length("text").cast("bigint").alias("length"))


@check(
    "rule_scorecard",
    """SELECT rule_id, column_name, kind, checked, violations, ROUND(violations / checked, 6) AS violation_rate, violations / checked <= tol AS passed FROM (
  SELECT 'not_null' AS rule_id, 'o_custkey' AS column_name, 'row' AS kind, COUNT(*) AS checked, COUNT(*) - COUNT(o_custkey) AS violations, 0.2 AS tol FROM dirty_orders
  UNION ALL SELECT 'range', 'o_totalprice', 'row', COUNT(*), COUNT(*) FILTER (o_totalprice NOT BETWEEN 0 AND 500000), 0 FROM dirty_orders
  UNION ALL SELECT 'pattern', 'o_orderpriority', 'row', COUNT(*), COUNT(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-5]-')), 0.1 FROM dirty_orders
  UNION ALL SELECT 'parses', 'o_orderdate_txt', 'row', COUNT(*), COUNT(*) FILTER (TRY_CAST(o_orderdate_txt AS DATE) IS NULL), 0.1 FROM dirty_orders
  UNION ALL SELECT 'key', 'o_orderkey', 'unique', COUNT(*), COUNT(*) - COUNT(DISTINCT o_orderkey), 0 FROM dirty_orders
  UNION ALL SELECT 'repeated', 'o_custkey', 'unique', (SELECT COUNT(*) FROM dirty_orders), COALESCE(SUM(c), 0)::BIGINT, 0 FROM (SELECT COUNT(*) AS c FROM dirty_orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey HAVING COUNT(*) > 1)
  UNION ALL SELECT 'customer', 'o_custkey', 'fk', COUNT(*), COUNT(*) FILTER (o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)), 0.5 FROM dirty_orders)""",
    "dirty_orders",
)
def rule_scorecard(t):
    good = t("customer").filter("c_acctbal >= 0")
    made = [
        checks.Rule("not_null", "o_custkey", "row", "o_custkey IS NULL", tolerance=0.2),
        checks.Rule("range", "o_totalprice", "row", "o_totalprice < 0 OR o_totalprice > 500000"),
        checks.Rule("pattern", "o_orderpriority", "row", "NOT (o_orderpriority RLIKE '^[1-5]-')", tolerance=0.1),
        checks.Rule("parses", "o_orderdate_txt", "row", "try_to_timestamp(o_orderdate_txt, 'yyyy-MM-dd') IS NULL", tolerance=0.1),
        checks.Rule("key", "o_orderkey", "unique"),
        checks.Rule("repeated", "o_custkey", "unique"),
        checks.Rule("customer", "o_custkey", "fk", reference=good, reference_key="c_custkey", tolerance=0.5),
    ]
    return r6(checks.rule_scorecard(t.view("dirty_orders"), made))


# -------------------------------------------------------------------- remediation
@check(
    "fill_mode_or_unknown",
    """WITH g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS p, o_custkey AS c FROM dirty_orders)
       SELECT o_orderkey, COALESCE(p, (SELECT p FROM g WHERE p IS NOT NULL GROUP BY p ORDER BY COUNT(*) DESC, p LIMIT 1)) AS filled, COALESCE(c::VARCHAR, 'Unknown') AS customer FROM g""",
    "dirty_orders",
)
def fill_mode_or_unknown(t):
    gaps = t.view("dirty_orders").select(
        "o_orderkey",
        F.expr("CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END").alias("filled"),
        F.col("o_custkey").cast("string").alias("customer"),
    )
    filled = checks.fill_mode_or_unknown(gaps, ["filled"])
    return checks.fill_mode_or_unknown(filled, ["customer"], use_mode=False)


@check("drop_missing", "SELECT o_orderkey FROM dirty_orders WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL", "dirty_orders")
def drop_missing(t):
    return checks.drop_missing(t.view("dirty_orders"), ["o_custkey", "o_totalprice"]).select("o_orderkey")


@check(
    "canonicalize_text",
    """WITH v AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN UPPER(o_orderpriority) WHEN 1 THEN LOWER(o_orderpriority) WHEN 2 THEN ' ' || o_orderpriority || '  ' ELSE REPLACE(o_orderpriority, ' ', '  ') END AS x FROM dirty_orders)
       SELECT 'x' AS column_name, COUNT(DISTINCT x) AS distinct_before, COUNT(DISTINCT regexp_replace(lower(trim(x)), ' +', ' ', 'g')) AS distinct_after FROM v""",
    "dirty_orders",
)
def canonicalize_text(t):
    mixed = t.view("dirty_orders").select(
        F.expr(
            """CASE o_orderkey % 4 WHEN 0 THEN UPPER(o_orderpriority) WHEN 1 THEN LOWER(o_orderpriority)
               WHEN 2 THEN ' ' || o_orderpriority || '  ' ELSE REPLACE(o_orderpriority, ' ', '  ') END"""
        ).alias("x")
    )
    return checks.canonicalize_text(mixed, ["x"])


# --------------------------------------------------------------- suggested rules
# one suggestion per order status and priority, with limits taken from the data,
# on known and unknown columns and with repeated wording
SUGGESTED = """
SELECT 'o_custkey' AS column_name, CONCAT('Customer key must not exceed ', CAST(MAX(o_custkey) AS STRING), '!') AS rule, 'validation' AS rule_type,
  CASE WHEN o_orderstatus = 'F' THEN 'High' ELSE CAST(NULL AS STRING) END AS severity, 'Medium' AS confidence, CAST(NULL AS STRING) AS enforcement_sql, 'Seen in one status.' AS rationale FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'o_custkey', 'customer key  MUST be positive', 'validation', 'Low', CASE WHEN o_orderpriority LIKE '1%' THEN 'High' ELSE 'Low' END, CONCAT('o_custkey > ', CAST(MIN(o_custkey) - 5 AS STRING)), o_orderpriority FROM orders GROUP BY o_orderpriority
UNION ALL SELECT 'no_such_column', CONCAT('Status ', o_orderstatus, ' needs review'), 'monitoring', 'Medium', 'High', '', CAST(NULL AS STRING) FROM orders GROUP BY o_orderstatus
"""
BOUNDS = "b AS (SELECT MIN(o_custkey) AS lo, MAX(o_custkey) AS hi FROM orders)"
ENRICHED = f"""SELECT column_name, rule, rule_type, severity,
  CASE WHEN column_name = 'no_such_column' OR derived THEN 'Low' ELSE confidence END AS confidence, enforcement_sql,
  CASE WHEN column_name = 'no_such_column' THEN COALESCE(rationale, '') || ' Column not found in profiling output; verify column name.'
       WHEN derived THEN COALESCE(rationale, '') || ' NOTE: threshold appears to match observed data min/max -> data-derived; requires business validation.' ELSE rationale END AS rationale,
  CASE WHEN column_name <> 'no_such_column' AND derived THEN 'llm-data-derived' ELSE 'llm' END AS source
  FROM (SELECT s.*, len(list_filter(regexp_extract_all(COALESCE(rule, '') || ' ' || COALESCE(enforcement_sql, ''), '[-+]?\\d*\\.\\d+|\\d+'), lambda x: x::DOUBLE IN (lo, hi))) > 0 AS derived
        FROM ({SUGGESTED}) s, b)"""


def suggested(t):
    t("orders").createOrReplaceTempView("orders")
    return t.spark.sql(SUGGESTED)


def bounds(t):
    return stats.column_stats(t("orders"), ["o_custkey", "o_totalprice"]).select("column_name", "min", "max")


@query("rules_enrich", f"WITH {BOUNDS} {ENRICHED}")
def rules_enrich(t):
    return rules.rules_enrich(suggested(t), bounds(t))


@query(
    "rules_union",
    f"""WITH {BOUNDS}, {LINE_PROFILE}, e AS ({ENRICHED})
  SELECT column_name, rule_type, severity, confidence, 'heuristic' AS source FROM ({HEURISTIC})
  UNION ALL SELECT column_name, rule_type, COALESCE(severity, 'Medium'), COALESCE(confidence, 'Medium'), source FROM e""",
)
def rules_union(t):
    made = rules.rules_heuristic(score.profile(t("lineitem"), as_of=AS_OF, rounded=False))
    union = rules.rules_union(made, rules.rules_enrich(suggested(t), bounds(t)))
    return union.select("column_name", "rule_type", "severity", "confidence", "source")


DEDUP = f"""k AS (SELECT *, trim(regexp_replace(lower(regexp_replace(rule, '[^a-zA-Z0-9 ]', ' ', 'g')), '\\s+', ' ', 'g')) AS key FROM ({ENRICHED})),
  d AS (SELECT * FROM k QUALIFY ROW_NUMBER() OVER (PARTITION BY column_name, key ORDER BY CASE lower(confidence) WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 3 ELSE 2 END,
     CASE source WHEN 'heuristic' THEN 0 WHEN 'llm' THEN 1 ELSE 2 END, rule) = 1)"""


@query("rules_dedup", f"WITH {BOUNDS}, {DEDUP} SELECT column_name, rule, rule_type, confidence, source FROM d")
def rules_dedup(t):
    enriched = rules.rules_enrich(suggested(t), bounds(t))
    return rules.rules_dedup(enriched).select("column_name", "rule", "rule_type", "confidence", "source")


@query(
    "source_label",
    f"""WITH {BOUNDS} SELECT source AS raw, CASE source WHEN 'llm' THEN 'AI-Inferred' ELSE 'AI-Inferred (Low Confidence)' END AS label, COUNT(*) AS n FROM ({ENRICHED}) GROUP BY 1, 2
      UNION ALL SELECT 'heuristic', 'Rule Engine', COUNT(*) FROM orders UNION ALL SELECT 'manual entry', 'Manual Entry', COUNT(*) FROM customer""",
)
def source_label(t):
    enriched = rules.rules_enrich(suggested(t), bounds(t)).groupBy(F.col("source").alias("raw")).agg(F.count("*").alias("n"))
    others = t("orders").agg(F.count("*").alias("n")).select(F.lit("heuristic").alias("raw"), "n").unionByName(
        t("customer").agg(F.count("*").alias("n")).select(F.lit("manual entry").alias("raw"), "n")
    )
    return enriched.unionByName(others).select("raw", rules.source_label(F.col("raw")).alias("label"), "n")


RISK = "ROUND(LEAST(100, GREATEST(0, 100 * CASE severity WHEN 'High' THEN 1.0 WHEN 'Medium' THEN 0.6 WHEN 'Low' THEN 0.3 ELSE 0.5 END * CASE confidence WHEN 'High' THEN 1.0 WHEN 'Medium' THEN 0.7 WHEN 'Low' THEN 0.4 ELSE 0.5 END * COALESCE((100 - dq_score) / 100, 0.5))), 2)"


@query(
    "risk_index",
    over_dirty_profile(f"SELECT column_name, rule_type, {RISK} AS governance_risk_index FROM ({HEURISTIC}) JOIN (SELECT column_name, ROUND(dq_score, 6) AS dq_score FROM prof) USING (column_name)"),
)
def risk_index(t):
    table = rules.governance_table(r6(dirty_profile(t)))
    return table.select("column_name", "rule_type", "governance_risk_index")


@query(
    "pseudo_logic",
    over_dirty_profile(
        f"""SELECT column_name, rule_type, CASE rule_type WHEN 'primary_key' THEN 'if ' || column_name || ' is missing or repeated -> flag record'
        WHEN 'stability' THEN 'if ' || column_name || ' changes between loads -> alert' WHEN 'datetime_validity' THEN 'if ' || column_name || ' is not a valid date -> flag record'
        WHEN 'staleness' THEN 'if latest ' || column_name || ' is too old -> alert' WHEN 'domain_constraint' THEN 'if ' || column_name || ' not in known values -> flag record'
        WHEN 'text_standardization' THEN 'if ' || column_name || ' differs from its standard form -> map value' WHEN 'non_negative' THEN 'if ' || column_name || ' < 0 -> flag record'
        WHEN 'missing_values' THEN 'if ' || column_name || ' is missing -> impute or reject' ELSE 'if ' || column_name || ' violates rule -> flag record' END AS pseudo_logic FROM ({HEURISTIC})"""
    ),
)
def pseudo_logic(t):
    return rules.governance_table(dirty_profile(t)).select("column_name", "rule_type", "pseudo_logic")


@query("governance_table")
def governance_table(t):
    """Derived and suggested rules of orders in one ranked table."""
    profiled = score.profile(t("orders"), as_of=AS_OF, order="o_orderkey", forest_key="o_orderkey")
    return rules.governance_table(profiled, suggested(t))
