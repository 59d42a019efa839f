"""SQL text of the column profile for the checking engine, one branch per column.

Written from the definitions, with that engine's own quantiles, windows and
regular expressions, not from the Spark plans.
"""

from __future__ import annotations

LINEITEM = [
    ("l_orderkey", "bigint", "number"),
    ("l_partkey", "bigint", "number"),
    ("l_suppkey", "bigint", "number"),
    ("l_linenumber", "int", "number"),
    ("l_quantity", "double", "number"),
    ("l_extendedprice", "double", "number"),
    ("l_discount", "double", "number"),
    ("l_tax", "double", "number"),
    ("l_returnflag", "string", "text"),
    ("l_linestatus", "string", "text"),
    ("l_shipdate", "timestamp_ntz", "moment"),
]
DIRTY_ORDERS = [
    ("o_orderkey", "bigint", "number"),
    ("o_custkey", "bigint", "number"),
    ("o_orderpriority", "string", "text"),
    ("o_totalprice", "double", "number"),
    ("o_orderdate_txt", "string", "text"),
    ("all_null", "double", "number"),
    ("constant_one", "int", "number"),
]
EVENTS = [
    ("event_id", "bigint", "number"),
    ("ts", "timestamp_ntz", "moment"),
    ("user_id", "bigint", "number"),
    ("event_type", "string", "text"),
    ("value", "double", "number"),
    ("props", "string", "text"),
]
ORDERS = [
    ("o_orderkey", "bigint", "number"),
    ("o_custkey", "bigint", "number"),
    ("o_orderstatus", "string", "text"),
    ("o_totalprice", "double", "number"),
    ("o_orderdate", "timestamp_ntz", "moment"),
    ("o_orderpriority", "string", "text"),
]


def per_column(columns, branch) -> str:
    return "\nUNION ALL ".join(branch(*c) for c in columns)


def metrics(source: str, columns, order: str | None = None) -> str:
    """A SELECT with the raw rates of every column."""

    def one(name: str, dtype: str, cls: str) -> str:
        number, text, moment = cls == "number", cls == "text", cls == "moment"
        whole = dtype in ("int", "bigint")
        placeholder = f"lower(trim(CAST({name} AS VARCHAR))) IN ('n/a','na','none','unknown','-','','0')" if (whole or text) else "FALSE"
        fmt = f"AVG(CASE WHEN regexp_full_match({name}, '[a-zA-Z0-9@.\\-_\\s]+') THEN 1.0 WHEN {name} IS NOT NULL THEN 0.0 END)" if text else "NULL"
        as_time = f"TRY_CAST({name} AS TIMESTAMP)" if (text or moment) else "CAST(NULL AS TIMESTAMP)"
        if number:
            z = f"(SELECT AVG(CASE WHEN s > 0 AND ABS({name} - m) > 3 * s THEN 1.0 ELSE 0.0 END) FROM {source}, (SELECT AVG({name}) AS m, STDDEV_POP({name}) AS s FROM {source}) WHERE {name} IS NOT NULL HAVING COUNT(*) >= 10)"
            iqr = f"(SELECT AVG(CASE WHEN {name} < q1 - 1.5 * (q3 - q1) OR {name} > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0.0 END) FROM {source}, (SELECT QUANTILE_CONT(CAST({name} AS DOUBLE), 0.25) AS q1, QUANTILE_CONT(CAST({name} AS DOUBLE), 0.75) AS q3 FROM {source}) WHERE {name} IS NOT NULL HAVING COUNT(*) >= 10)"
        else:
            z = iqr = "NULL"
        if order and (text or moment):
            ordered = f"""(SELECT NOT BOOL_OR(COALESCE(d < p, FALSE)) OR NOT BOOL_OR(COALESCE(d > p, FALSE)) FROM
                (SELECT {as_time} AS d, LAG({as_time}) OVER (ORDER BY {order}) AS p FROM {source} WHERE {as_time} IS NOT NULL))"""
        else:
            ordered = "FALSE"
        lo, hi = (f"CAST(MIN({name}) AS DOUBLE)", f"CAST(MAX({name}) AS DOUBLE)") if number else ("NULL", "NULL")
        return f"""SELECT '{name}' AS column_name, '{dtype}' AS type, '{cls}' AS cls, COUNT(*) AS n, COUNT({name}) AS non_null,
          COUNT(DISTINCT {name}) AS n_unique,
          COALESCE((SELECT -SUM(p * LN(p + 1e-9)) FROM (SELECT COUNT(*) / SUM(COUNT(*)) OVER () AS p FROM {source} WHERE {name} IS NOT NULL GROUP BY {name})), 0) AS entropy,
          COALESCE(AVG(CASE WHEN {name} IS NULL THEN NULL WHEN {placeholder} THEN 1.0 ELSE 0.0 END), 0) AS placeholder_ratio,
          COALESCE({fmt}, 1.0) AS format_consistency,
          COALESCE({z}, 0) AS outlier_z, COALESCE({iqr}, 0) AS outlier_iqr,
          COUNT({as_time}) AS parsed, MIN({as_time}) AS min_time, MAX({as_time}) AS max_time,
          COALESCE({ordered}, FALSE) AS ordered,
          {lo} AS min, {hi} AS max, {f"AVG({name})" if number else "NULL"} AS mean, {f"STDDEV_SAMP({name})" if number else "NULL"} AS std
        FROM {source}"""

    return per_column(columns, one)


def profile_ctes(source: str, columns, as_of: str, order: str | None = None) -> str:
    """CTEs m, f, g and prof; prof has one row per column with unrounded scores."""
    return f"""m AS ({metrics(source, columns, order)}),
f AS (SELECT *,
  non_null / n AS completeness, n_unique / n AS uniqueness,
  CASE WHEN cls = 'moment' THEN non_null / n ELSE 1.0 END AS dtype_conformity,
  (regexp_matches(lower(column_name), '(id|code|number|_key|_no)$') AND n_unique >= 0.9 * n)
    OR (n_unique = n AND type IN ('int', 'bigint', 'string')) AS is_id,
  regexp_matches(lower(column_name), 'date|time|created|updated|dob')
    OR (non_null > 0 AND parsed > 0.7 * non_null) OR COALESCE(cls = 'number' AND mean > 1e10, FALSE) AS is_datetime,
  CAST(FLOOR(EPOCH(TIMESTAMP '{as_of}' - max_time) / 86400) AS BIGINT) AS fresh
  FROM m),
g AS (SELECT *,
  CASE WHEN parsed > 0 THEN LEAST(100, GREATEST(0, 20 * (parsed / n
     + 1 - CASE WHEN fresh >= 0 THEN fresh / 365.0 ELSE 1 END
     + CASE WHEN min_time > TIMESTAMP '1900-01-01' THEN 1 ELSE 0 END
     + CASE WHEN max_time < TIMESTAMP '{as_of}' + INTERVAL 5 DAY THEN 1 ELSE 0 END
     + CASE WHEN ordered THEN 1 ELSE 0.8 END))) END AS moment_score,
  LEAST(100, GREATEST(0, 25 * completeness + 15 * (1 - placeholder_ratio)
     + 15 * (dtype_conformity + format_consistency + 1 + 1) / 4 + 10 * format_consistency
     + 10 * (1 - (outlier_z + outlier_iqr) / 3) + 10 + 15 * uniqueness)) AS plain_score
  FROM f),
prof AS (SELECT *,
  CASE WHEN is_id THEN 100 WHEN is_datetime THEN COALESCE(moment_score, 0) ELSE plain_score END AS dq_score,
  CASE WHEN is_id THEN 'Identifier'
       WHEN is_datetime THEN CASE WHEN moment_score IS NULL THEN 'Invalid Datetime' WHEN moment_score >= 90 THEN 'Fresh & Valid'
            WHEN moment_score >= 75 THEN 'Valid but Slightly Stale' WHEN moment_score >= 60 THEN 'Old / Semi-Valid' ELSE 'Invalid / Corrupted' END
       WHEN plain_score >= 90 THEN 'Excellent' WHEN plain_score >= 75 THEN 'Good' WHEN plain_score >= 60 THEN 'Moderate' ELSE 'Poor' END AS dq_grade,
  100 * (1 - completeness) AS missing_pct, 100 * (1 - uniqueness) AS duplicate_pct
  FROM g)"""
