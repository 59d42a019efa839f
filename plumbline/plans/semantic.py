"""Semantic review, reply tables and treatment effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import causal, relations, replies, review, stats
from plumbline.plans.profiles import cramers_sql, mode_share_sql
from plumbline.plans.registry import query, r6
from plumbline.sources.views import with_views

REPLY = "verdict string, reason string"
STRIPPED = "TRIM(REPLACE(REPLACE(reply, '```json', ''), '```', ''), E' \\n\\t\\r')"
# the same three attempts, in the other engine's own functions
PARSED = f"""SELECT reply_id, column_name, j ->> '$.verdict' AS verdict, j ->> '$.reason' AS reason FROM (
  SELECT reply_id, column_name, CASE WHEN json_valid(reply) THEN reply::JSON WHEN json_valid({STRIPPED}) THEN ({STRIPPED})::JSON
    ELSE TRY_CAST(NULLIF(regexp_extract(reply, '(?s)\\{{.*\\}}'), '') AS JSON) END AS j FROM reply_rows)"""


def parsed_replies(t):
    rows = t.view("reply_rows")
    return rows.withColumn("j", replies.parse_json(F.col("reply"), REPLY)).select(
        "reply_id", "column_name", F.col("j.verdict").alias("verdict"), F.col("j.reason").alias("reason")
    )


# ----------------------------------------------------------------------- replies
@query("reply_strip_fence", with_views(f"SELECT reply_id, {STRIPPED} AS body FROM reply_rows", "reply_rows"))
def reply_strip_fence(t):
    return t.view("reply_rows").select("reply_id", replies.strip_fence(F.col("reply")).alias("body"))


@query("reply_parse_json", with_views(PARSED, "reply_rows"))
def reply_parse_json(t):
    return parsed_replies(t)


COLUMN_REPLY = """CASE WHEN o_orderkey % 3 = 0 THEN CONCAT('Plot these. COLUMNS=[', o_orderstatus, ', ', o_orderpriority, ']')
  WHEN o_orderkey % 3 = 1 THEN CONCAT('Columns: ', o_orderpriority, ',', o_orderstatus) ELSE 'nothing to plot' END"""


@query(
    "reply_column_list",
    """SELECT o_orderkey AS reply_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus || '|' || o_orderpriority
       WHEN o_orderkey % 3 = 1 THEN o_orderpriority || '|' || o_orderstatus ELSE '' END AS columns FROM orders""",
)
def reply_column_list(t):
    rows = t("orders").select(F.col("o_orderkey").alias("reply_id"), F.expr(COLUMN_REPLY).alias("reply"))
    return rows.select("reply_id", F.array_join(replies.column_list(F.col("reply")), "|").alias("columns"))


@query(
    "profile_payload",
    """SELECT column_name, '{"column_name":"' || column_name || '","n_unique":' || u || ',"n":' || n || '}' AS payload FROM (
       SELECT 'l_returnflag' AS column_name, COUNT(DISTINCT l_returnflag) AS u, COUNT(*) AS n FROM lineitem
       UNION ALL SELECT 'l_tax', COUNT(DISTINCT l_tax), COUNT(*) FROM lineitem)""",
)
def profile_payload(t):
    profiled = stats._with_distinct(t("lineitem"), ["l_returnflag", "l_tax"]).select("column_name", "n_unique", "n")
    return replies.payload(profiled)


# ------------------------------------------------------------------------ review
@query("review_payload")
def review_payload(t):
    return review.review_payload(t("orders"), "o_orderkey", "o_orderstatus", ["o_orderpriority", "o_totalprice"])


JUDGED = f"""SELECT column_name, COUNT(*) AS n_replies, CAST(SUM(reply_id % 10 + 1) AS BIGINT) AS samples_checked, CASE WHEN BOOL_OR(COALESCE(verdict, '') = 'inconsistent') THEN 'inconsistent'
   WHEN BOOL_OR(COALESCE(verdict, '') = 'possibly inconsistent') THEN 'possibly inconsistent' ELSE 'consistent' END AS verdict FROM ({PARSED}) GROUP BY column_name"""


@query(
    "verdict_aggregate",
    with_views(
        f"""SELECT column_name, 'categorical' AS type, n_replies, samples_checked, verdict, IF(verdict = 'consistent', 'Medium', 'High') AS confidence,
        IF(verdict = 'consistent', '', 'Classification might be wrong') AS discrepancy_flag FROM ({JUDGED})""",
        "reply_rows",
    ),
)
def verdict_aggregate(t):
    return review.verdict_aggregate(parsed_replies(t).withColumn("n_rows", F.expr("reply_id % 10 + 1")))


SIGNAL_PAIRS = {"l_returnflag": ["l_linestatus", "l_tax"], "l_linestatus": ["l_returnflag"]}


@query(
    "verdict_gate",
    f"""WITH rep AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'l_returnflag' ELSE 'l_linestatus' END AS column_name,
         CASE l_returnflag WHEN 'R' THEN 'inconsistent' WHEN 'A' THEN 'consistent' ELSE 'possibly inconsistent' END AS verdict FROM lineitem),
       j AS (SELECT column_name, COUNT(*) AS n_replies, MIN(CASE verdict WHEN 'inconsistent' THEN 0 WHEN 'possibly inconsistent' THEN 1 ELSE 2 END) AS worst FROM rep GROUP BY 1),
       s AS (SELECT col2 AS column_name, ROUND(AVG(mode_share), 6) AS avg_mode_share, MAX(cramers_v) AS max_cramers_v FROM
         ({mode_share_sql('lineitem', 'l_linestatus', 'l_returnflag')} UNION ALL {mode_share_sql('lineitem', 'l_tax', 'l_returnflag')} UNION ALL {mode_share_sql('lineitem', 'l_returnflag', 'l_linestatus')}) JOIN
         ({cramers_sql('lineitem', 'l_linestatus', 'l_returnflag')} UNION ALL {cramers_sql('lineitem', 'l_tax', 'l_returnflag')} UNION ALL {cramers_sql('lineitem', 'l_returnflag', 'l_linestatus')}) USING (col1, col2) GROUP BY col2)
       SELECT column_name, n_replies, ['inconsistent', 'possibly inconsistent', 'consistent'][worst + 1] AS verdict, 'Low' AS confidence, avg_mode_share, max_cramers_v,
         IF(worst < 2 AND (avg_mode_share > 0.5 OR max_cramers_v > 0.5), 'Classification might be wrong', '') AS discrepancy_flag FROM j JOIN s USING (column_name)""",
)
def verdict_gate(t):
    line = t("lineitem")
    made = line.selectExpr(
        "CASE WHEN l_orderkey % 2 = 0 THEN 'l_returnflag' ELSE 'l_linestatus' END AS column_name",
        "CASE l_returnflag WHEN 'R' THEN 'inconsistent' WHEN 'A' THEN 'consistent' END AS verdict",
    )
    return r6(review.verdict_gate(made, relations.statistical_signals(line, SIGNAL_PAIRS)))


@query(
    "reasons_dedup",
    with_views(
        f"""WITH f AS (SELECT column_name, reason, MIN(reply_id) AS i FROM ({PARSED}) WHERE reason IS NOT NULL AND reason <> '' GROUP BY 1, 2),
        r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY i) AS k FROM f)
        SELECT column_name, STRING_AGG(reason, ' | ' ORDER BY k) AS reasons FROM r WHERE k <= 5 GROUP BY column_name""",
        "reply_rows",
    ),
)
def reasons_dedup(t):
    found = review.reasons_dedup(parsed_replies(t))
    return found.select("column_name", F.array_join("reasons", " | ").alias("reasons"))


@query(
    "numeric_verdict",
    """WITH rep AS (SELECT l_orderkey * 8 + l_linenumber AS reply_id, CASE WHEN l_discount > 0.09 THEN 'invalid' WHEN l_tax > 0.07 THEN 'suspicious' ELSE 'valid' END AS v, l_returnflag, l_orderkey FROM lineitem),
       told AS (SELECT *, v || ' by ' || l_returnflag AS reason FROM rep WHERE v <> 'valid'),
       f AS (SELECT reason, MIN(reply_id) AS i FROM told GROUP BY 1),
       w AS (SELECT (SELECT STRING_AGG(reason, '; ' ORDER BY i) FROM (SELECT * FROM f ORDER BY i LIMIT 5)) AS reasons,
         (SELECT STRING_AGG(l_orderkey::VARCHAR, '; ' ORDER BY reply_id) FROM (SELECT * FROM told ORDER BY reply_id LIMIT 5)) AS examples,
         (SELECT 'first: ' || reason FROM f ORDER BY i LIMIT 1) AS description)
       SELECT 'l_discount' AS column_name, 'numeric' AS type, COUNT(*) AS samples_checked, CASE WHEN BOOL_OR(v = 'invalid') THEN 'invalid' WHEN BOOL_OR(v = 'suspicious') THEN 'suspicious' ELSE 'valid' END AS verdict,
         'High' AS confidence, CASE WHEN BOOL_OR(v <> 'valid') THEN 'Logical or semantic inconsistency' ELSE '' END AS discrepancy_flag, ANY_VALUE(reasons) AS example_reasons, ANY_VALUE(examples) AS example_rows, ANY_VALUE(description) AS description FROM rep, w
       UNION ALL SELECT 'l_quantity', 'numeric', COUNT(*), 'valid', 'High', '', '', '', 'No semantic inconsistencies detected.' FROM lineitem""",
)
def numeric_verdict(t):
    line = t("lineitem")
    made = line.selectExpr(
        "'l_discount' AS column_name",
        "l_orderkey * 8 + l_linenumber AS reply_id",
        "CASE WHEN l_discount > 0.09 THEN 'invalid' WHEN l_tax > 0.07 THEN 'suspicious' ELSE 'valid' END AS verdict",
        "l_returnflag",
        "l_orderkey",
    ).selectExpr(
        "column_name", "reply_id", "verdict", "CASE WHEN verdict <> 'valid' THEN verdict || ' by ' || l_returnflag END AS reason",
        "CASE WHEN verdict <> 'valid' THEN CAST(l_orderkey AS STRING) END AS example", "'first: ' || CASE WHEN verdict <> 'valid' THEN verdict || ' by ' || l_returnflag END AS description",
    )
    checked = stats.column_stats(line, ["l_discount", "l_quantity"]).select("column_name", F.col("non_null").alias("n"))
    found = review.numeric_verdict(made, checked)
    return found.withColumns({c: F.array_join(c, "; ") for c in ("example_reasons", "example_rows")})


@query(
    "semantic_summary",
    with_views(
        f"""WITH f AS (SELECT column_name, reason, MIN(reply_id) AS i FROM ({PARSED}) WHERE reason IS NOT NULL AND reason <> '' GROUP BY 1, 2),
        r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY i) AS k FROM f),
        x AS (SELECT column_name, STRING_AGG(reason, '; ' ORDER BY k) AS reasons FROM r WHERE k <= 5 GROUP BY column_name)
        SELECT column_name, '- **' || column_name || '**: Classification might be wrong | ' || COALESCE(reasons, '') AS line FROM ({JUDGED}) LEFT JOIN x USING (column_name) WHERE verdict <> 'consistent'""",
        "reply_rows",
    ),
)
def semantic_summary(t):
    rows = parsed_replies(t).withColumns({"description": F.lit(None).cast("string"), "example": F.lit(None).cast("string")})
    return review.semantic_summary(review.findings(rows))


# ------------------------------------------------------------------------ causal
@query(
    "causal_prepare",
    with_views(
        """SELECT SUM(row_key)::BIGINT AS key_sum, COUNT(*) AS n, ROUND(AVG(treatment), 6) AS treatment, ROUND(AVG(outcome), 4) AS outcome,
        ROUND(AVG(DATE_DIFF('day', (SELECT MIN(l_shipdate) FROM lineitem), l_shipdate)), 4) AS l_shipdate,
        ROUND(AVG(code), 6) AS l_linestatus, MAX(code)::DOUBLE AS top_code
        FROM causal_lineitem JOIN (SELECT s, DENSE_RANK() OVER (ORDER BY s) - 1 AS code FROM (SELECT DISTINCT l_linestatus AS s FROM lineitem)) ON s = l_linestatus""",
        "causal_lineitem",
    ),
)
def causal_prepare(t):
    prepared = causal.causal_prepare(
        t.view("causal_lineitem"), "treatment", "outcome", ["l_shipdate", "l_linestatus"], "row_key"
    )
    folded = prepared.agg(
        # added up wider than the keys: many large keys pass a bigint; a total that no bigint holds is NULL
        F.sum(F.col("row_key").cast("decimal(20,0)")).try_cast("bigint").alias("key_sum"),
        F.count("*").alias("n"),
        F.round(F.avg("treatment"), 6).alias("treatment"),
        F.round(F.avg("outcome"), 4).alias("outcome"),
        F.round(F.avg("l_shipdate"), 4).alias("l_shipdate"),
        F.round(F.avg("l_linestatus"), 6).alias("l_linestatus"),
        F.max("l_linestatus").alias("top_code"),
    )
    return folded


@query(
    "category_codes",
    "SELECT c_name AS value, ROW_NUMBER() OVER (ORDER BY c_name) - 1 AS code FROM (SELECT DISTINCT c_name FROM customer)",
)
def category_codes(t):
    return causal.category_codes(t("customer"), "c_name")


@query("derived_change", "SELECT l_orderkey, l_partkey, l_linenumber, ROUND(l_extendedprice - l_quantity * 1000, 4) AS change FROM lineitem")
def derived_change(t):
    df = t("lineitem").withColumn("before", F.col("l_quantity") * 1000)
    changed = causal.derived_change(df, "before", "l_extendedprice", "change")
    return r6(changed.select("l_orderkey", "l_partkey", "l_linenumber", "change"), 4)


STRATA_SQL = """s AS (SELECT stratum, COUNT(*) AS n, AVG(outcome) FILTER (treatment = 1) - AVG(outcome) FILTER (treatment = 0) AS gap,
  VAR_SAMP(outcome) FILTER (treatment = 1) / COUNT(*) FILTER (treatment = 1) + VAR_SAMP(outcome) FILTER (treatment = 0) / COUNT(*) FILTER (treatment = 0) AS v
  FROM causal_lineitem GROUP BY stratum)"""


# With one discrete confounder a row's matches are all rows of the other arm in its stratum: the matched variance in closed form.
MATCHED_SQL = """m AS (SELECT COUNT(*) FILTER (treatment = 1)::DOUBLE AS n1, COUNT(*) FILTER (treatment = 0)::DOUBLE AS n0,
  AVG(outcome) FILTER (treatment = 1) - AVG(outcome) FILTER (treatment = 0) AS gap,
  VAR_SAMP(outcome) FILTER (treatment = 1) AS v1, VAR_SAMP(outcome) FILTER (treatment = 0) AS v0 FROM causal_lineitem GROUP BY stratum),
a AS (SELECT SUM((n1 + n0) * gap) / SUM(n1 + n0) AS ate, SUM(n1 + n0) AS n FROM m),
e AS (SELECT SQRT(SUM((n1 - 1) * v1 + (n0 - 1) * v0 + (n1 + n0) * (gap - ate) ** 2
  + v1 * (n0 * n0 / n1 + 2 * n0 - n0 / n1) + v0 * (n1 * n1 / n0 + 2 * n1 - n1 / n0))) / ANY_VALUE(n) AS se, ANY_VALUE(ate) AS ate, ANY_VALUE(n) AS n FROM m, a)"""


@query(
    "ate_psm",
    with_views(
        f"""WITH {MATCHED_SQL} SELECT 'treatment' AS treatment, 'outcome' AS outcome, 'stratum' AS confounders, ROUND(ate, 4) AS ate,
        ROUND(ate - 1.959963984540054 * se, 4) AS ci_low, ROUND(ate + 1.959963984540054 * se, 4) AS ci_high, CAST(n AS BIGINT) AS rows_used,
        (SELECT COUNT(*) FROM lineitem WHERE l_returnflag = 'R') AS treated, (SELECT COUNT(*) FROM lineitem WHERE l_returnflag <> 'R') AS controls,
        '' AS converted_columns, '' AS dropped_columns FROM e""",
        "causal_lineitem",
    ),
)
def ate_psm(t):
    """With one discrete confounder every stratum is one score, so matching equals exact strata."""
    return r6(causal.ate_psm(t.view("causal_lineitem"), "treatment", "outcome", ["stratum"], "row_key"), 4).drop("p_value")


@query("ate_psm_continuous")
def ate_psm_continuous(t):
    return r6(
        causal.ate_psm(t.view("causal_lineitem"), "treatment", "outcome", ["stratum", "l_quantity", "l_shipdate", "l_linestatus"], "row_key"), 4
    )


def nearest_sql(arm: str) -> str:
    """SQL columns: the nearest scores below and above (or at) each score that have rows of the arm, and their means."""
    up, down = "(ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "(ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    held = {"s": f"CASE WHEN n{arm} > 0 THEN score END", "r": f"CASE WHEN n{arm} > 0 THEN y{arm} / n{arm} END"}
    return ", ".join(f"LAST_VALUE({c} IGNORE NULLS) OVER {w} AS {side}_{k}{arm}" for side, w in (("low", up), ("high", down)) for k, c in held.items())


def picked_sql(arm: str) -> str:
    """The mean at the nearest score, the lower one on a tie."""
    return f"CASE WHEN high_s{arm} IS NULL OR score - low_s{arm} <= high_s{arm} - score THEN low_r{arm} ELSE high_r{arm} END"


@query(
    "ate_matched_score",
    f"""WITH f AS (SELECT l_extendedprice AS score, COUNT(*) FILTER (l_returnflag = 'R')::DOUBLE AS n1, COUNT(*) FILTER (l_returnflag <> 'R')::DOUBLE AS n0,
          COALESCE(SUM(l_quantity) FILTER (l_returnflag = 'R'), 0) AS y1, COALESCE(SUM(l_quantity) FILTER (l_returnflag <> 'R'), 0) AS y0 FROM lineitem GROUP BY 1),
        n AS (SELECT *, {nearest_sql('1')}, {nearest_sql('0')} FROM f)
        SELECT ROUND(SUM(y1 - n1 * ({picked_sql('0')}) + n0 * ({picked_sql('1')}) - y0) / SUM(n1 + n0), 6) AS ate,
          CAST(SUM(n1 + n0) AS BIGINT) AS rows_used, CAST(SUM(n1) AS BIGINT) AS treated, CAST(SUM(n0) AS BIGINT) AS controls FROM n""",
)
def ate_matched_score(t):
    """Matching on a given score with many levels, most of which only one arm has."""
    scored = t("lineitem").selectExpr("l_extendedprice AS score", "CAST(l_returnflag = 'R' AS INT) AS treatment", "l_quantity AS outcome", "l_orderkey * 8 + l_linenumber AS row_key")
    return r6(causal.ate_matched(scored, "treatment", "outcome", "row_key").drop("std_error"))


@query(
    "ate_stratified",
    with_views(
        f"""WITH {STRATA_SQL}, a AS (SELECT SUM(n * gap) / SUM(n) AS ate, SQRT(SUM(n * n * v)) / SUM(n) AS e, SUM(n) AS n, COUNT(*) AS k FROM s)
        SELECT 'treatment' AS treatment, 'outcome' AS outcome, ROUND(ate, 4) AS ate, ROUND(ate - 1.959963984540054 * e, 4) AS ci_low, ROUND(ate + 1.959963984540054 * e, 4) AS ci_high, n::BIGINT AS rows_used, k AS strata FROM a""",
        "causal_lineitem",
    ),
)
def ate_stratified(t):
    return r6(causal.ate_stratified(t.view("causal_lineitem"), "treatment", "outcome", ["stratum"]), 4)


@query("ate_interval")
def ate_interval(t):
    return r6(causal.ate_interval(t.view("causal_lineitem"), "row_key", "treatment", "outcome", ["stratum"]), 4)
