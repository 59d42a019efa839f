"""Outlier rates and rows: z-score, quartile fences, isolation forest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import as_double, numeric_long, of_kind, share
from plumbline.operators.isolation import flagged_counts
from plumbline.operators.ordering import Cuts, exact_quantiles

MIN_VALUES = 10
Z_LIMIT = 3.0
FENCE = 1.5


def z_bounds(long: DataFrame) -> DataFrame:
    """(column_name, n, mean, std_pop)."""
    return long.groupBy("column_name").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std_pop")
    )


def iqr_bounds(long: DataFrame, cuts: Cuts | None = None) -> DataFrame:
    """(column_name, q1, q3, low_fence, high_fence)."""
    return _fences(exact_quantiles(long, ["column_name"], [0.25, 0.75], cuts))


def _fences(quartiles: DataFrame) -> DataFrame:
    q1, q3 = F.col("quantiles")[0], F.col("quantiles")[1]
    return quartiles.select(
        "column_name",
        q1.alias("q1"),
        q3.alias("q3"),
        (q1 - FENCE * (q3 - q1)).alias("low_fence"),
        (q3 + FENCE * (q3 - q1)).alias("high_fence"),
    )


def approx_iqr_bounds(long: DataFrame, accuracy: int = 10_000) -> DataFrame:
    q = long.groupBy("column_name").agg(F.percentile_approx("value", [0.25, 0.75], accuracy).alias("q"))
    gap = F.col("q")[1] - F.col("q")[0]
    return q.select(
        "column_name",
        F.col("q")[0].alias("q1"),
        F.col("q")[1].alias("q3"),
        (F.col("q")[0] - FENCE * gap).alias("low_fence"),
        (F.col("q")[1] + FENCE * gap).alias("high_fence"),
    )


def is_z_outlier(value: Column) -> Column:
    # a constant column has no spread and no outliers
    return (F.col("std_pop") > 0) & (F.abs(value - F.col("mean")) > Z_LIMIT * F.col("std_pop"))


def is_iqr_outlier(value: Column) -> Column:
    return (value < F.col("low_fence")) | (value > F.col("high_fence"))


def _rate(flagged: Column) -> Column:
    enough = F.col("n") >= MIN_VALUES
    return F.when(enough, share(flagged, F.col("n"))).otherwise(F.lit(0.0))


def zscore_rates(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    names = list(names if names is not None else of_kind(df, "numeric"))
    long = numeric_long(df, names)
    flagged = (
        long.join(F.broadcast(z_bounds(long)), "column_name")  # one row per column
        .groupBy("column_name")
        .agg(F.max("n").alias("n"), F.count_if(is_z_outlier(F.col("value"))).alias("flagged"))
    )
    return flagged.select("column_name", "n", _rate(F.col("flagged")).alias("outlier_z"))


def iqr_rates(df: DataFrame, names: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    names = list(names if names is not None else of_kind(df, "numeric"))
    long = numeric_long(df, names)
    bounds = approx_iqr_bounds(long) if approx else iqr_bounds(long)
    flagged = (
        long.join(F.broadcast(bounds), "column_name")
        .groupBy("column_name")
        .agg(
            F.count("*").alias("n"),
            F.max("q1").alias("q1"),
            F.max("q3").alias("q3"),
            F.count_if(is_iqr_outlier(F.col("value"))).alias("flagged"),
        )
    )
    return flagged.select("column_name", "n", "q1", "q3", _rate(F.col("flagged")).alias("outlier_iqr"))


def rates_from_counts(counts: DataFrame, moments: DataFrame, cuts: Cuts) -> DataFrame:
    """Both rates from (column_name, value, n) and (column_name, n, mean, std_pop).

    The counts are already shuffled for the distinct counts of the profile; the
    fences and the flags read that same exchange instead of scanning the data again.
    """
    quartiles = exact_quantiles(counts, ["column_name"], [0.25, 0.75], cuts, weight="n")
    bounds = moments.join(F.broadcast(_fences(quartiles)), "column_name")
    value, m = F.col("value"), F.col("m")
    flagged = (
        counts.withColumnRenamed("n", "m")
        .join(F.broadcast(bounds), "column_name")  # one row per column
        .groupBy("column_name")
        .agg(
            F.max("n").alias("n"),
            F.sum(F.when(is_z_outlier(value), m).otherwise(0)).alias("z"),
            F.sum(F.when(is_iqr_outlier(value), m).otherwise(0)).alias("iqr"),
        )
    )
    return flagged.select(
        "column_name", _rate(F.col("z")).alias("outlier_z"), _rate(F.col("iqr")).alias("outlier_iqr")
    )


def approx_rates(long: DataFrame) -> DataFrame:
    """Both rates with sketched quartiles, no shuffle of values."""
    bounds = z_bounds(long).join(F.broadcast(approx_iqr_bounds(long)), "column_name")
    value = F.col("value")
    flagged = (
        long.join(F.broadcast(bounds), "column_name")
        .groupBy("column_name")
        .agg(
            F.max("n").alias("n"),
            F.count_if(is_z_outlier(value)).alias("z"),
            F.count_if(is_iqr_outlier(value)).alias("iqr"),
        )
    )
    return flagged.select(
        "column_name", _rate(F.col("z")).alias("outlier_z"), _rate(F.col("iqr")).alias("outlier_iqr")
    )


def forest_rates(
    df: DataFrame, names: Sequence[str], key: str | None = None, contamination: float | None = None, seed: int = 42
) -> DataFrame:
    """Share of rows an isolation forest flags; ``contamination`` None = score above 0.5.
    The trees draw from value counts: ``key`` is accepted for old callers and decides nothing."""
    long = numeric_long(df, names)
    counts = flagged_counts(long, contamination, seed)
    return counts.select("column_name", "n", _rate(F.col("flagged")).alias("outlier_iso"))


def combined_rates(df: DataFrame, names: Sequence[str], key: str | None = None, seed: int = 42) -> DataFrame:
    z = zscore_rates(df, names).select("column_name", "outlier_z")
    iso = forest_rates(df, names, key, contamination=0.05, seed=seed).select("column_name", "outlier_iso")
    return z.join(F.broadcast(iso), "column_name", "left").select(
        "column_name",
        "outlier_z",
        "outlier_iso",
        (100 * F.greatest("outlier_z", F.coalesce("outlier_iso", F.lit(0.0)))).alias("outlier_pct"),
    )


def outlier_rows(df: DataFrame, name: str, method: str = "iqr") -> DataFrame:
    """Rows of ``df`` outside the bounds of one column, with the bounds' verdict."""
    long = numeric_long(df, [name])
    bounds = (iqr_bounds(long) if method == "iqr" else z_bounds(long)).drop("column_name")
    value = as_double(df.schema[name])
    wanted = bounds.select(F.struct("*")).scalar()  # one row by construction
    if method == "iqr":
        outside = (value < wanted["low_fence"]) | (value > wanted["high_fence"])
    else:
        outside = (wanted["std_pop"] > 0) & (F.abs(value - wanted["mean"]) > Z_LIMIT * wanted["std_pop"])
    return df.filter(outside)
