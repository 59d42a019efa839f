"""Joins, tagged unions and reshaping shared by the other operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import MISSING_LABEL, as_text, col, present, share


def _reference_keys(reference: DataFrame, key: str) -> DataFrame:
    values = as_text(reference.schema[key])
    return reference.select(values.alias("value")).filter(F.col("value").isNotNull()).distinct()


def membership_counts(df: DataFrame, name: str, reference: DataFrame, key: str) -> DataFrame:
    """(value, n, found): values are counted before the join, so a hot value joins once."""
    values = df.select(as_text(df.schema[name]).alias("value")).filter(F.col("value").isNotNull())
    counted = values.groupBy("value").agg(F.count("*").alias("n"))
    known = _reference_keys(reference, key).withColumn("found", F.lit(True))
    return counted.join(known, "value", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def membership_rate(df: DataFrame, name: str, reference: DataFrame, key: str) -> DataFrame:
    """Share of non-missing values present in the reference; NULL where the reference is empty."""
    counted = membership_counts(df, name, reference, key)
    empty = ~_reference_keys(reference, key).exists()
    rate = counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("found"), F.col("n"))), F.lit(0)).alias("matched"),
    )
    return rate.select("n", "matched", F.when(~empty, share(F.col("matched"), F.col("n"))).alias("rate"))


def references_by_name(names: Sequence[str], tables: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, str]]:
    """column -> (table, its first column), the older way to find references: the first table that has a column of the
    same name in any case, or any table if the name ends in "code"."""
    found = {}
    for name in names:
        for table in tables.values():
            if name.lower() in (c.lower() for c in table.columns) or name.lower().endswith("code"):
                found[name] = (table, table.columns[0])
                break
    return found


def dangling_rows(df: DataFrame, name: str, reference: DataFrame, key: str, keep_null: bool = False) -> DataFrame:
    """Rows whose value is missing from the reference (anti join)."""
    known = reference.select(col(key).alias("_ref")).filter(F.col("_ref").isNotNull()).distinct()
    base = df if keep_null else df.filter(present(df.schema[name]).isNotNull())
    return base.join(known, col(name) == F.col("_ref"), "left_anti")


def union_tagged(tables: dict[str, DataFrame], tag: str = "period") -> DataFrame:
    tagged = [df.withColumn(tag, F.lit(label)) for label, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def category(df: DataFrame, name: str):
    """The column as text with missing values labelled."""
    return F.coalesce(as_text(df.schema[name]), F.lit(MISSING_LABEL))


def side_counts(df: DataFrame, name: str, side: str, baseline: str, target: str) -> DataFrame:
    """Category counts of both sides, 0 where a side lacks the category.
    One grouping instead of a full outer join."""
    return (
        df.select(category(df, name).alias("value"), col(side).alias("side"))
        .groupBy("value")
        .agg(
            F.count_if(F.col("side") == baseline).alias("baseline_n"),
            F.count_if(F.col("side") == target).alias("target_n"),
        )
    )


def complement(df: DataFrame, predicate) -> DataFrame:
    """Rows a filter does not keep; rows where it is NULL are not kept either."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot([col(i) for i in ids], [col(v) for v in values], name, value)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long contingency table (value_a, value_b, n)."""
    return (
        df.select(category(df, a).alias("value_a"), category(df, b).alias("value_b"))
        .groupBy("value_a", "value_b")
        .agg(F.count("*").alias("n"))
    )


def crosstab_wide(df: DataFrame, a: str, b: str, levels: Sequence[str]) -> DataFrame:
    """One output column per listed level of ``b``."""
    counted = df.select(category(df, a).alias("value_a"), category(df, b).alias("value_b"))
    return counted.groupBy("value_a").pivot("value_b", list(levels)).agg(F.count(F.lit(1))).fillna(0)


def profile_lookup(rules: DataFrame, profiled: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Attach profile columns to each rule. The profile has one row per column."""
    return rules.join(F.broadcast(profiled.select("column_name", *wanted)), "column_name", "left")
