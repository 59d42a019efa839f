"""Relationships between columns: correlation, mapping consistency, association.

All pairs of a request share one scan: tasks add up moments or count cells for
all of them, and only these are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import MISSING_LABEL, as_double, as_text, col, of_kind, share
from plumbline.functions.comoments import CoMoments
from plumbline.functions.contingency import CELLS, count_pairs
from plumbline.operators.stats import levels, mean_text_length, uniqueness

PAIR = ["col1", "col2"]
HIGH_CORRELATION = 0.9

# Name patterns of review candidates and of context columns.
CANDIDATE_NAME = r"id|code|type|category|status|class|segment"
CONTEXT_NAME = r"name|title|desc|label|product|fund"


# ----------------------------------------------------------------- correlation
def corr_matrix(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(col_a, col_b, corr): Pearson over rows where both are present, each unordered pair once; NULL where a side is
    constant on these rows, NaN where one of them is infinite.

    A task fills one ``CoMoments`` buffer for all pairs by matrix products. The buffers, one row a task, are merged in
    two steps, by as many tasks as a shuffle has and then by one. No code is generated per pair, and no data row moves.
    """
    names = list(names if names is not None else of_kind(df, "numeric"))
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    values = df.select(*[as_double(df.schema[n]).alias(f"v{i}") for i, n in enumerate(names)])
    width = len(names)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield CoMoments.of_values(width, batches).packed()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield CoMoments.merged(width, batches).packed()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield CoMoments.merged(width, batches).correlations(names)

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = values.mapInArrow(fill, CoMoments.SHAPE).repartition(tasks).mapInArrow(merge, CoMoments.SHAPE)
    return parts.repartition(1).mapInArrow(measure, "col_a string, col_b string, corr double")


def full_corr_matrix(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Both orders and the diagonal, as a heat-map wants them."""
    names = list(names if names is not None else of_kind(df, "numeric"))
    half = corr_matrix(df, names)
    mirrored = half.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "corr")
    diagonal = df.sparkSession.createDataFrame([(n, n, 1.0) for n in names], "col_a string, col_b string, corr double")
    return half.unionByName(mirrored).unionByName(diagonal)


def high_corr_pairs(df: DataFrame, names: Sequence[str] | None = None, above: float = HIGH_CORRELATION) -> DataFrame:
    return corr_matrix(df, names).filter(F.abs("corr") > above)


# -------------------------------------------------------------- pairs of columns
def candidate_pairs(df: DataFrame, max_levels: int = 50) -> DataFrame:
    """Pairs of columns with few distinct values, in column order. The list of columns is paired with itself, one row per column."""
    places = F.create_map(*[F.lit(x) for i, n in enumerate(df.columns) for x in (n, i)])
    few = levels(df, max_levels).filter(F.col("levels").isNotNull()).withColumn("position", places[F.col("column_name")])
    listed = few.agg(F.array_sort(F.collect_list(F.struct("position", "column_name"))).alias("c"))
    paired = listed.select(F.posexplode("c").alias("i", "left"), "c").select(
        "left", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("right")
    )
    return paired.select(F.col("left.column_name").alias("col1"), F.col("right.column_name").alias("col2"))


def pair_counts(df: DataFrame, pairs: Sequence[tuple[str, str]], missing: str | None = None) -> DataFrame:
    """(col1, col2, v1, v2, n); rows with a missing side are dropped unless labelled.

    Tasks code the columns by dictionary and count the codes of every pair over runs of rows, so that a row is read once
    for all pairs and only counted cells are shuffled.
    """
    names = sorted({n for pair in pairs for n in pair}, key=df.columns.index)
    text = [as_text(df.schema[n]) for n in names]
    if missing is not None:
        text = [F.coalesce(t, F.lit(missing)) for t in text]
    values = df.select(*[t.alias(f"c{i}") for i, t in enumerate(text)])
    cells = values.mapInArrow(lambda batches: count_pairs(batches, names, pairs), CELLS)
    return cells.groupBy(*PAIR, "v1", "v2").agg(F.sum("n").alias("n"))


def both_ways(pairs: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    return [*pairs, *[(b, a) for a, b in pairs]]


def fd_consistency(
    df: DataFrame, pairs: Sequence[tuple[str, str]], min_mode_share: float | None = None
) -> DataFrame:
    """Keys of col1 that map to more than one value of col2.

    ``min_mode_share`` keeps only keys whose most frequent value has less than that share.
    """
    per_key = pair_counts(df, pairs).groupBy(*PAIR, F.col("v1").alias("key")).agg(
        F.count("*").alias("n_distinct"),
        F.sum("n").alias("rows"),
        share(F.max("n"), F.sum("n")).alias("mode_share"),
    )
    broken = per_key.filter(F.col("n_distinct") > 1)
    return broken if min_mode_share is None else broken.filter(F.col("mode_share") < min_mode_share)


def cross_relation_report(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per inconsistent pair, both directions tested."""
    broken = fd_consistency(df, both_ways(pairs))
    return broken.groupBy(*PAIR).agg(
        F.count("*").alias("inconsistent_keys"),
        F.max("n_distinct").alias("max_distinct"),
        F.sum("rows").alias("rows"),
        F.min("mode_share").alias("min_mode_share"),
    )


def cramers_v(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Bias-corrected association, missing values as their own level; 0 where a side has one level."""
    counts = pair_counts(df, pairs, MISSING_LABEL)
    rows = counts.groupBy(*PAIR, "v1").agg(F.sum("n").alias("row_n"))
    columns = counts.groupBy(*PAIR, "v2").agg(F.sum("n").alias("col_n"))
    sizes = rows.groupBy(*PAIR).agg(F.count("*").cast("double").alias("r"), F.sum("row_n").cast("double").alias("n_all"))
    widths = columns.groupBy(*PAIR).agg(F.count("*").cast("double").alias("k"))
    # chi2 / n = sum over cells of n_ij^2 / (row_i * col_j), less 1
    squares = (
        counts.join(rows, [*PAIR, "v1"])
        .join(columns, [*PAIR, "v2"])
        .groupBy(*PAIR)
        .agg(F.sum(F.col("n") / F.col("row_n").cast("double") * F.col("n") / F.col("col_n")).alias("s"))
    )
    joined = squares.join(F.broadcast(sizes), PAIR).join(F.broadcast(widths), PAIR)  # one row per pair
    r, k, n = F.col("r"), F.col("k"), F.col("n_all")
    free = F.nullif(n - 1, F.lit(0.0))
    phi2 = F.greatest(F.lit(0.0), F.col("s") - 1 - (k - 1) * (r - 1) / free)
    narrow = F.least(k - (k - 1) ** 2 / free, r - (r - 1) ** 2 / free) - 1
    v = F.when((r >= 2) & (k >= 2) & (narrow > 0), F.sqrt(phi2 / narrow)).otherwise(F.lit(0.0))
    return joined.select(*PAIR, v.alias("cramers_v"))


def conditional_mode_share(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Mean over the keys of col1 of the share of their most frequent col2 value."""
    per_key = pair_counts(df, pairs).groupBy(*PAIR, "v1").agg(share(F.max("n"), F.sum("n")).alias("s"))
    return per_key.groupBy(*PAIR).agg(F.avg("s").alias("mode_share"), F.count("*").alias("n_keys"))


def statistical_signals(df: DataFrame, contexts: dict[str, Sequence[str]]) -> DataFrame:
    """Per target: mean mode share and largest association over its context columns."""
    pairs = [(c, target) for target, cs in contexts.items() for c in cs]
    shares = conditional_mode_share(df, pairs)
    return (
        cramers_v(df, pairs)
        .join(F.broadcast(shares), PAIR, "left")
        .groupBy(F.col("col2").alias("column_name"))
        .agg(
            F.avg(F.coalesce("mode_share", F.lit(0.0))).alias("avg_mode_share"),
            F.max("cramers_v").alias("max_cramers_v"),
        )
    )


# ----------------------------------------------------------- review candidates
def select_candidates(df: DataFrame, max_levels: int = 50, include_numeric: bool = True) -> DataFrame:
    """Columns worth a semantic review, with the number of their distinct values: by name, few of these, or numeric."""
    few, numeric = F.col("n_unique") <= max_levels, F.col("column_name").isin(of_kind(df, "numeric"))
    by_size = (few | numeric) if include_numeric else (few & ~numeric)
    named = F.lower("column_name").rlike(CANDIDATE_NAME)
    return uniqueness(df).filter(named | by_size).select("column_name", named.alias("by_name"), "n_unique")


def rank_context_columns(df: DataFrame, target: str, k: int = 3) -> DataFrame:
    """The k best context columns for a target; ties in column order."""
    others = [n for n in df.columns if n != target]
    places = df.sparkSession.createDataFrame(
        [(n, i) for i, n in enumerate(others)], "column_name string, position int"
    )
    # "more than one value" needs the least and the greatest value only
    ends = df.agg(*[(F.min(as_text(df.schema[n])) < F.max(as_text(df.schema[n]))).alias(n) for n in others])
    varied = ends.unpivot([], [col(n) for n in others], "column_name", "varied")
    described = (
        F.broadcast(places)
        .join(F.broadcast(varied), "column_name", "left")
        .join(F.broadcast(mean_text_length(df, others)), "column_name", "left")
    )
    points = (
        F.when(F.lower("column_name").rlike(CONTEXT_NAME), 2.0).otherwise(0.0)
        + F.when(F.col("mean_length") > 5, 1.0).otherwise(0.0)
        + F.when(F.col("varied"), 0.5).otherwise(0.0)
    )
    return (
        described.select("column_name", "position", points.alias("score"))
        .filter(F.col("score") > 0)
        .orderBy(F.desc("score"), "position")
        .limit(k)
        .select("column_name", "score")
    )


