"""Executable validation checks, and a scorecard over a table of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import as_identity, as_text, col, present, share, unpivot_values
from plumbline.operators.drift import checked_predicate
from plumbline.operators.reshape import dangling_rows
from plumbline.operators.stats import WHITESPACE, ntz, parse_datetime

STALE_DAYS = 90
MAX_TEXT = 255
FREE_TEXT_FILL = "Unknown"


# ------------------------------------------------------- conditions that violate
def missing(df: DataFrame, name: str) -> Column:
    return present(df.schema[name]).isNull()


def out_of_range(name: str, low: float | None, high: float | None) -> Column:
    outside = F.lit(False)
    if low is not None:
        outside = outside | (col(name) < low)
    if high is not None:
        outside = outside | (col(name) > high)
    return F.coalesce(outside, F.lit(False))


def not_matching(name: str, pattern: str) -> Column:
    return F.coalesce(~col(name).rlike(pattern), F.lit(False))


def stale(name: str, as_of: str, max_days: int = STALE_DAYS) -> Column:
    limit = ntz(as_of) - F.expr(f"INTERVAL {int(max_days)} DAYS")
    return F.coalesce(col(name).cast("timestamp_ntz") < limit, F.lit(False))


def unparsable(name: str) -> Column:
    return parse_datetime(col(name).cast("string")).isNull()


def too_long(name: str, limit: int = MAX_TEXT) -> Column:
    return F.coalesce(F.length(col(name)) > limit, F.lit(False))


# ---------------------------------------------------------------- row-level checks
def check_not_null(df: DataFrame, name: str) -> DataFrame:
    return df.filter(missing(df, name))


def check_missing_count(df: DataFrame, names: Sequence[str]) -> DataFrame:
    wide = df.agg(*[F.count_if(missing(df, n)).alias(n) for n in names])
    return wide.unpivot([], [col(n) for n in names], "column_name", "missing")


def check_unique(df: DataFrame, name: str) -> DataFrame:
    """Repeated values and how often they occur."""
    return df.groupBy(col(name).alias("value")).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def check_range(df: DataFrame, name: str, low: float | None = None, high: float | None = None) -> DataFrame:
    return df.filter(out_of_range(name, low, high))


def check_regex(df: DataFrame, name: str, pattern: str) -> DataFrame:
    return df.filter(not_matching(name, pattern))


def check_fk(df: DataFrame, name: str, reference: DataFrame, key: str) -> DataFrame:
    return dangling_rows(df, name, reference, key)


def check_staleness(df: DataFrame, name: str, as_of: str, max_days: int = STALE_DAYS) -> DataFrame:
    return df.filter(stale(name, as_of, max_days))


def check_datetime_parse(df: DataFrame, name: str) -> DataFrame:
    return df.filter(unparsable(name))


def check_taxonomy(df: DataFrame, name: str, taxonomy: DataFrame, key: str) -> DataFrame:
    """Values outside the taxonomy with their row counts (counted first, joined second)."""
    values = df.select(as_text(df.schema[name]).alias("value")).filter(F.col("value").isNotNull())
    counted = values.groupBy("value").agg(F.count("*").alias("n"))
    known = taxonomy.select(as_text(taxonomy.schema[key]).alias("value")).distinct()
    return counted.join(known, "value", "left_anti")


def check_max_length(df: DataFrame, name: str, limit: int = MAX_TEXT) -> DataFrame:
    return df.filter(too_long(name, limit))


# ------------------------------------------------------------------------ scorecard
@dataclass(frozen=True)
class Rule:
    """``kind`` is row (a violating condition in SQL), unique or fk."""

    rule_id: str
    column: str
    kind: str
    condition: str | None = None
    reference: DataFrame | None = None
    reference_key: str | None = None
    tolerance: float = 0.0


def rule_scorecard(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule_id, column_name, kind, checked, violations, violation_rate, passed).

    Two scans of the table, however many rules there are: all row rules share one aggregate, and all unique and fk rules
    one count of values. A unique rule counts the rows of repeated values, an fk rule the rows whose value the reference
    lacks; the references are stacked, each value with the rules that know it, and joined once.
    """
    if unknown := {r.kind for r in rules} - {"row", "unique", "fk"}:
        raise ValueError(f"unknown rule kinds {sorted(unknown)}")
    row_rules, value_rules = [r for r in rules if r.kind == "row"], [r for r in rules if r.kind != "row"]
    parts = []
    if row_rules:
        violations = [F.count_if(checked_predicate(r.condition)) for r in row_rules]
        parts.append(_scores(df, row_rules, [F.count(F.lit(1))] * len(row_rules), violations))
    if value_rules:
        counted = unpivot_values(df, list(dict.fromkeys(r.column for r in value_rules)), as_identity)
        counted = counted.groupBy("column_name", "value").agg(F.count("*").alias("n")).withColumn("known", F.array().cast("array<int>"))
        references = [
            r.reference.select(F.lit(r.column).alias("column_name"), as_identity(r.reference.schema[r.reference_key]).alias("value"), F.lit(i).alias("rule"))
            for i, r in enumerate(value_rules) if r.kind == "fk"
        ]
        if references:
            held = reduce(DataFrame.unionByName, references).filter(F.col("value").isNotNull())
            held = held.groupBy("column_name", "value").agg(F.collect_set("rule").alias("known"))  # at most one entry a rule
            counted = counted.drop("known").join(held, ["column_name", "value"], "left")
        checked, violations = [], []
        for i, r in enumerate(value_rules):
            own = F.col("column_name") == r.column
            bad = F.col("n") > 1 if r.kind == "unique" else ~F.coalesce(F.array_contains("known", i), F.lit(False))
            checked.append(F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)))
            violations.append(F.coalesce(F.sum(F.when(own & F.col("value").isNotNull() & bad, F.col("n"))), F.lit(0)))
        parts.append(_scores(counted, value_rules, checked, violations))
    scored = reduce(DataFrame.unionByName, parts).withColumn(
        "violation_rate", F.coalesce(share(F.col("violations"), F.col("checked")), F.lit(0.0))
    )
    return scored.withColumn("passed", F.col("violation_rate") <= F.col("tolerance")).drop("tolerance")


def _scores(table: DataFrame, rules: Sequence[Rule], checked: Sequence[Column], violations: Sequence[Column]) -> DataFrame:
    """One aggregate over ``table``, then one row per rule."""
    measures = [c.alias(f"{name}{i}") for name, columns in (("c", checked), ("v", violations)) for i, c in enumerate(columns)]
    rows = [
        F.struct(
            F.lit(r.rule_id).alias("rule_id"),
            F.lit(r.column).alias("column_name"),
            F.lit(r.kind).alias("kind"),
            F.col(f"c{i}").alias("checked"),
            F.col(f"v{i}").alias("violations"),
            F.lit(r.tolerance).alias("tolerance"),
        )
        for i, r in enumerate(rules)
    ]
    return table.agg(*measures).select(F.inline(F.array(*rows)))


# ---------------------------------------------------------------------- remediation
def mode_values(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row with the most frequent value of each text column (ties: the smallest), from one count of all columns."""
    counted = df.unpivot([], [col(n).cast("string").alias(n) for n in names], "column_name", "value")
    counted = counted.filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    best = [F.min(F.when(F.col("column_name") == n, F.struct(-F.col("n"), F.col("value"))))["value"].alias(n) for n in names]
    return counted.agg(*best)


def fill_mode_or_unknown(df: DataFrame, names: Sequence[str], use_mode: bool = True) -> DataFrame:
    """Fill missing texts with the column's mode, or with 'Unknown' where there is none."""
    replacements = [F.lit(None).cast("string") for _ in names]
    if use_mode and names:
        # The same subquery for every column: it runs once.
        modes = mode_values(df, names).select(F.array(*[col(n) for n in names])).scalar()
        replacements = [F.get(modes, F.lit(i)) for i in range(len(names))]
    return df.withColumns({n: F.coalesce(col(n), r, F.lit(FREE_TEXT_FILL)) for n, r in zip(names, replacements, strict=True)})


def drop_missing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    keep = F.lit(True)
    for n in names:
        keep = keep & ~missing(df, n)
    return df.filter(keep)


def canonical(text: Column) -> Column:
    """Trimmed, lower case, inner white space collapsed."""
    return F.regexp_replace(F.lower(F.trim(text, F.lit(WHITESPACE))), r"\s+", " ")


def canonicalize_text(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Distinct values before and after canonicalisation."""
    long = df.unpivot([], [col(n) for n in names], "column_name", "value").filter(F.col("value").isNotNull())
    counted = long.groupBy("column_name", "value").agg(F.lit(1).alias("one"))
    merged = counted.groupBy("column_name", canonical(F.col("value")).alias("canonical")).agg(F.count("*").alias("m"))
    return merged.groupBy("column_name").agg(
        F.sum("m").alias("distinct_before"), F.count("*").alias("distinct_after")
    )
