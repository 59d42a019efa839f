"""Chart-ready tables. Rendering is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import MISSING_LABEL, as_double, as_text, col, kind, present, share
from plumbline.operators.ordering import exact_quantiles, numeric_cuts
from plumbline.operators.reshape import category

HIST_BINS = 30
KDE_BINS, KDE_GRID = 200, 200


def _bounds(values: DataFrame) -> Column:
    """struct(low, high, n) of the single column ``v``: one row by construction."""
    return values.agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n")
    ).select(F.struct("low", "high", "n")).scalar()


def even_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin, the top one closed; 0 for a constant column."""
    width = (high - low) / F.lit(float(bins))
    place = F.floor((value - low) / F.nullif(width, F.lit(0.0))).cast("int")
    return F.when(high > low, F.least(place, F.lit(bins - 1))).otherwise(F.lit(0))


def chart_histogram(df: DataFrame, name: str, hue: str | None = None, bins: int = HIST_BINS) -> DataFrame:
    """(bin, bin_low, bin_high, [hue], n)."""
    group = [category(df, hue).alias("hue")] if hue else []
    values = df.select(as_double(df.schema[name]).alias("v"), *group).filter(F.col("v").isNotNull())
    b = _bounds(values.select("v"))
    low, high = b["low"], b["high"]
    width = (high - low) / F.lit(float(bins))
    placed = values.withColumn("bin", even_bin(F.col("v"), low, high, bins))
    counted = placed.groupBy("bin", *(["hue"] if hue else [])).agg(F.count("*").alias("n"))
    return counted.select(
        "bin",
        (low + width * F.col("bin")).alias("bin_low"),
        (low + width * (F.col("bin") + 1)).alias("bin_high"),
        *(["hue"] if hue else []),
        "n",
    )


def chart_kde(df: DataFrame, name: str, bins: int | None = None, grid: int = KDE_GRID) -> DataFrame:
    """(i, x, density): Gaussian kernel over the counted distinct values, Scott bandwidth. The kernel of a value is summed
    per grid point inside the tasks, so ``grid`` rows a task are shuffled. ``bins`` puts the centres of that many even
    bins in place of the values: quick, but wrong where a bin is not much narrower than the bandwidth (skewed columns)."""
    values = df.select(as_double(df.schema[name]).alias("v")).filter(F.col("v").isNotNull())
    b = _bounds(values)
    low, high = b["low"], b["high"]
    spread = values.agg(F.stddev_samp("v").alias("s"), F.count("v").alias("n"))
    bandwidth = spread.select(F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).scalar()
    if bins is None:
        counted = values.groupBy("v").agg(F.count("*").alias("n"))
    else:
        step = (high - low) / F.lit(float(bins))
        counted = values.groupBy(even_bin(F.col("v"), low, high, bins).alias("bin")).agg(F.count("*").alias("n"))
        counted = counted.select((low + step * (F.col("bin") + 0.5)).alias("v"), "n")
    points = counted.select("v", "n", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i")).withColumn(
        "x", low + (high - low) * F.col("i") / F.lit(float(grid - 1))
    )
    z = (F.col("x") - F.col("v")) / F.nullif(bandwidth, F.lit(0.0))
    summed = points.groupBy("i", "x").agg(F.sum(F.col("n") * F.exp(-0.5 * z * z)).alias("kernel"), F.sum("n").cast("double").alias("total"))
    scale = F.nullif(F.col("total") * bandwidth * F.sqrt(F.lit(2.0) * F.pi()), F.lit(0.0))
    return summed.select("i", "x", (F.col("kernel") / scale).alias("density"))


def chart_value_counts(df: DataFrame, name: str) -> DataFrame:
    return df.select(as_text(df.schema[name]).alias("value")).filter(F.col("value").isNotNull()).groupBy("value").agg(
        F.count("*").alias("n")
    )


def chart_pie_values(df: DataFrame, names: str, values: str) -> DataFrame:
    """Sum per name and its share of the whole."""
    summed = df.groupBy(category(df, names).alias("name")).agg(
        F.sum(as_double(df.schema[values])).alias("total")
    )
    whole = summed.agg(F.sum("total").alias("t")).scalar()
    return summed.select("name", "total", share(F.col("total"), whole).alias("share"))


def _keys(df: DataFrame, x: str, hue: str | None) -> list[Column]:
    return [category(df, x).alias("x"), *([category(df, hue).alias("hue")] if hue else [])]


def chart_bar(df: DataFrame, x: str, y: str | None = None, hue: str | None = None) -> DataFrame:
    """Stacked bars: sum of y per x (and hue), or row counts without y."""
    height = F.sum(as_double(df.schema[y])) if y else F.count("*").cast("double")
    return df.groupBy(*_keys(df, x, hue)).agg(height.alias("y"), F.count("*").alias("n"))


def chart_line(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """Mean of y per x (and hue)."""
    keys = [col(x).alias("x"), *([category(df, hue).alias("hue")] if hue else [])]
    return (
        df.filter(present(df.schema[x]).isNotNull())
        .groupBy(*keys)
        .agg(F.avg(as_double(df.schema[y])).alias("y"), F.count("*").alias("n"))
    )


def chart_scatter_ols(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """Least-squares fit of y on x per hue."""
    group = [category(df, hue).alias("hue")] if hue else []
    fx, fy = as_double(df.schema[x]), as_double(df.schema[y])
    points = df.select(*group, fx.alias("x"), fy.alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    return points.groupBy(*(["hue"] if hue else [])).agg(
        F.count("*").alias("n"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"),
    )


def scatter_points(df: DataFrame, x: str, y: str, key: str, hue: str | None = None, points: int | None = None) -> DataFrame:
    """Every row as a point, or a drawable number of ``points``, chosen by key hash."""
    shown = [col(x).alias("x"), col(y).alias("y"), *([category(df, hue).alias("hue")] if hue else [])]
    chosen = df if points is None else df.orderBy(F.xxhash64(col(key)), col(key)).limit(points)
    return chosen.select(*shown)


def chart_box(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 IQR) and the number of points beyond."""
    keys = ["x", *(["hue"] if hue else [])]
    long = df.select(F.lit(y).alias("column_name"), *_keys(df, x, hue), as_double(df.schema[y]).alias("value")).filter(
        F.col("value").isNotNull()
    )
    # Quartiles and fences both read the counted values, so a row never meets its category's box.
    counted = long.groupBy("column_name", *keys, "value").agg(F.count("*").alias("m"))
    q = exact_quantiles(counted, keys, [0.25, 0.5, 0.75], numeric_cuts(long), few_keys=False, weight="m")
    q1, q3 = F.col("quantiles")[0], F.col("quantiles")[2]
    boxes = q.select(*keys, "n", q1.alias("q1"), F.col("quantiles")[1].alias("median"), q3.alias("q3"))
    fence_low = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    fence_high = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(fence_low, fence_high)
    return (
        counted.join(boxes, keys)
        .groupBy(*keys)
        .agg(
            F.max("n").alias("n"),
            F.max("q1").alias("q1"),
            F.max("median").alias("median"),
            F.max("q3").alias("q3"),
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("m"))), F.lit(0)).alias("n_beyond"),
        )
    )


def chart_drift_overlay(sided: DataFrame, name: str, bins: int = HIST_BINS) -> DataFrame:
    """Histogram of both sides over shared edges: (bin, bin_low, bin_high, baseline_n, target_n)."""
    values = sided.select(as_double(sided.schema[name]).alias("v"), "in_base", "in_target").filter(
        F.col("v").isNotNull() & (F.col("in_base") | F.col("in_target"))
    )
    b = _bounds(values.select("v"))
    width = (b["high"] - b["low"]) / F.lit(float(bins))
    placed = values.withColumn("bin", even_bin(F.col("v"), b["low"], b["high"], bins))
    counted = placed.groupBy("bin").agg(
        F.count_if("in_base").alias("baseline_n"), F.count_if("in_target").alias("target_n")
    )
    return counted.select(
        "bin",
        (b["low"] + width * F.col("bin")).alias("bin_low"),
        (b["low"] + width * (F.col("bin") + 1)).alias("bin_high"),
        "baseline_n",
        "target_n",
    )


def chart_drift_shares(sided: DataFrame, name: str) -> DataFrame:
    """(value, period, pct): category share by side, long form."""
    counts = (
        sided.select(F.coalesce(as_text(sided.schema[name]), F.lit(MISSING_LABEL)).alias("value"), "in_base", "in_target")
        .groupBy("value")
        .agg(F.count_if("in_base").alias("nb"), F.count_if("in_target").alias("nt"))
        .filter((F.col("nb") > 0) | (F.col("nt") > 0))
    )
    whole = counts.agg(F.sum("nb").alias("b"), F.sum("nt").alias("t")).select(F.struct("b", "t")).scalar()
    shares = counts.select(
        "value",
        share(F.col("nb"), whole["b"]).alias("baseline"),
        share(F.col("nt"), whole["t"]).alias("target"),
    )
    return shares.unpivot(["value"], ["baseline", "target"], "period", "pct")


def chart_worst_columns(df: DataFrame, ranking: DataFrame, k: int = 3, bins: int = HIST_BINS) -> DataFrame:
    """Distribution rows of the k lowest-scored columns: numeric ones binned, others counted.

    ``ranking`` is a score ranking (place, column_name); only the k names reach the driver.
    """
    worst: Sequence[str] = [
        r["column_name"] for r in ranking.filter(F.col("place") <= k).orderBy("place").select("column_name").collect()
    ]
    parts = []
    for name in worst:
        if kind(df.schema[name].dataType) == "numeric":
            rows = chart_histogram(df, name, bins=bins).select(F.col("bin").cast("string").alias("label"), "n")
        else:
            rows = chart_value_counts(df, name).select(F.col("value").alias("label"), "n")
        parts.append(rows.select(F.lit(name).alias("column_name"), "label", "n"))
    if not parts:
        return df.sparkSession.createDataFrame([], "column_name string, label string, n bigint")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


