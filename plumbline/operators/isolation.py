"""Isolation forest on single columns (Liu, Ting and Zhou 2008).

Every tree looks at no more than 256 values, whatever the table size. In one
dimension a tree is a list of split points with a path length between them, so
the forest's mean path length is a step function of the value. The trees are
grown one per task group, the step function is a table of at most 25 600 rows
per column, and the full data is flagged by a sorted merge with its steps.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ordering import Cuts, numeric_cuts, with_range

# executors get the functions themselves and need not have this package installed
register_pickle_by_value(sys.modules[__name__])

TREES = 100
TREE_VALUES = 256
HEIGHT = 8  # ceil(log2(256))
AUTO_SCORE = 0.5 + 1e-9  # a constant column scores 0.5 but for rounding
EULER_GAMMA = 0.5772156649015329
POOL = TREES * TREE_VALUES


def mean_path(n: int) -> float:
    """Average path length of an unsuccessful search among n values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def grow(values: np.ndarray, rng: np.random.Generator, depth: int = 0) -> list[tuple[float, float]]:
    """[(upper bound, path length)] of the leaves, left to right; the last bound is +inf."""
    if depth == HEIGHT or len(values) <= 1 or values[0] == values[-1]:
        return [(math.inf, depth + mean_path(len(values)))]
    split = rng.uniform(values[0], values[-1])
    at = int(np.searchsorted(values, split, side="right"))
    if at == len(values):  # the draw hit the maximum
        at = int(np.searchsorted(values, split, side="left"))
        split = float(values[at - 1])
    left, right = grow(values[:at], rng, depth + 1), grow(values[at:], rng, depth + 1)
    return [*left[:-1], (split, left[-1][1]), *right]


def _tree(pdf: pd.DataFrame) -> pd.DataFrame:
    """At most 256 values in, at most 256 steps out: where the path length changes, and
    by how much. The first step also brings the tree's normal path length."""
    column, tree = pdf["column_name"].iloc[0], int(pdf["tree"].iloc[0])
    seed = int(pdf["seed"].iloc[0]) * 1_000_003 + tree
    leaves = grow(np.sort(pdf["value"].to_numpy()), np.random.default_rng(seed))
    lows = [-math.inf] + [bound for bound, _ in leaves[:-1]]
    paths = np.array([length for _, length in leaves])
    change = np.diff(paths, prepend=0.0)
    normal = [mean_path(len(pdf)) or 1.0] + [0.0] * (len(leaves) - 1)
    return pd.DataFrame({"column_name": column, "above": lows, "change": change, "normal": normal})


def _pool(long: DataFrame, seed: int) -> DataFrame:
    """About 25 600 values per column, drawn from the value counts and dealt to 100 trees.

    A value with m of n rows is drawn 25 600 m / n times, the fraction decided by a hash of the value: no row key is
    needed, and a value that fills a third of the rows is one row here.
    """
    counts = long.groupBy("column_name", "value").agg(F.count("*").alias("m"))
    totals = counts.groupBy("column_name").agg(F.sum("m").alias("n"))
    unit = F.pmod(F.xxhash64("value", "column_name", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    everywhere = F.col("n") <= TREE_VALUES  # then each tree sees all the values
    wanted = F.lit(float(POOL)) * F.col("m") / F.col("n")
    draws = F.when(everywhere, F.col("m") * TREES).otherwise(F.floor(wanted) + (unit < wanted - F.floor(wanted)).cast("int"))
    drawn = counts.join(F.broadcast(totals), "column_name").withColumn("draws", draws).filter("draws > 0")  # one row per column
    dealt = drawn.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("draws")))).withColumn(
        "tree", F.pmod(F.when(everywhere, F.col("draw")).otherwise(F.xxhash64("value", "draw", F.lit(seed + 1))), F.lit(TREES)).cast("int")
    )
    order = Window.partitionBy("column_name", "tree").orderBy(F.xxhash64("value", "draw", F.lit(seed + 2)))
    return (
        dealt.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= TREE_VALUES)
        .select("column_name", "tree", "value", F.lit(seed).alias("seed"))
    )


def forest_steps(long: DataFrame, seed: int = 42) -> DataFrame:
    """(column_name, above, score): the anomaly score of values in (above, next above].

    At most 25 600 rows per column.
    """
    grown = (
        _pool(long, seed)
        .groupBy("column_name", "tree")
        .applyInPandas(_tree, "column_name string, above double, change double, normal double")
    )
    deltas = grown.groupBy("column_name", "above").agg(
        F.sum("change").alias("change"), F.sum("normal").alias("normal")
    )
    whole = Window.partitionBy("column_name")
    run = whole.orderBy("above").rowsBetween(Window.unboundedPreceding, 0)
    ratio = F.sum("change").over(run) / F.sum("normal").over(whole)
    return deltas.select("column_name", "above", F.pow(F.lit(2.0), -ratio).alias("score"))


def with_score(rows: DataFrame, steps: DataFrame, cuts: Cuts | None = None) -> DataFrame:
    """Add ``score`` to (column_name, value, ...): that of the last step below the value.

    Steps and values are sorted together inside value ranges, and the last step of each range is carried to the next
    ones, so no task holds a column's steps. Values that repeat much should come counted.
    """
    cuts = cuts or numeric_cuts(rows.select("column_name", "value"))
    others = [f for f in rows.schema if f.name not in ("column_name", "value")]
    marks = steps.select(
        "column_name", F.col("above").alias("value"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in others], F.lit(1).alias("_mark"), "score"
    )
    both = rows.withColumn("_mark", F.lit(0)).withColumn("score", F.lit(None).cast("double")).unionByName(marks)
    ranged = with_range(both, cuts)
    group = ["column_name", "range_id"]
    is_step = F.col("_mark") == 1
    last = ranged.groupBy(*group).agg(F.max_by(F.when(is_step, F.col("score")), F.when(is_step, F.col("value"))).alias("last"))
    earlier = Window.partitionBy("column_name").orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*group, F.last("last", True).over(earlier).alias("_before"))
    # A value that equals a step's bound lies below the step.
    so_far = Window.partitionBy(*group).orderBy("value", "_mark").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(carried, group).withColumn("score", F.coalesce(F.last("score", True).over(so_far), F.col("_before")))
    return placed.filter("_mark = 0").select(*rows.columns, "score")


def flagged_counts(long: DataFrame, contamination: float | None = None, seed: int = 42) -> DataFrame:
    """(column_name, n, flagged) over all values; each distinct value is scored once."""
    counts = long.groupBy("column_name", "value").agg(F.count("*").alias("m"))
    scored = with_score(counts, forest_steps(long, seed), numeric_cuts(long))
    if contamination is None:
        flagged = F.coalesce(F.sum(F.when(F.col("score") > AUTO_SCORE, F.col("m"))), F.lit(0))
        return scored.groupBy("column_name").agg(F.sum("m").alias("n"), flagged.alias("flagged"))
    # values share a score per step, so the score quantile needs step counts only
    per_score = scored.groupBy("column_name", "score").agg(F.sum("m").alias("m"))
    whole = Window.partitionBy("column_name")
    run = whole.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    counted = per_score.select(
        "column_name", "score", "m", F.sum("m").over(run).alias("cum"), F.sum("m").over(whole).alias("n")
    )
    position = (1 - F.lit(float(contamination))) * (F.col("n") - 1)

    def at(rank):
        return F.max(F.when((F.col("cum") - F.col("m") <= rank) & (rank < F.col("cum")), F.col("score")))

    cutoffs = counted.groupBy("column_name").agg(
        at(F.floor(position)).alias("lo"), at(F.ceil(position)).alias("hi"), F.max(position).alias("position")
    ).select(
        "column_name",
        (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("position") - F.floor("position"))).alias("cutoff"),
    )
    return (
        counted.join(F.broadcast(cutoffs), "column_name")
        .groupBy("column_name")
        .agg(
            F.max("n").alias("n"),
            F.coalesce(F.sum(F.when(F.col("score") > F.col("cutoff"), F.col("m"))), F.lit(0)).alias("flagged"),
        )
    )
