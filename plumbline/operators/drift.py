"""Drift between a baseline and a target: KS, chi-square, PSI; over time and by segment.

Every numeric measure starts from one table of value counts per side, so equal
values cost one row, and from running totals inside value ranges
(``ordering``), so no column is sorted in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import (
    MISSING_LABEL,
    as_text,
    col,
    kind,
    numeric_long,
    of_kind,
    share,
    unpivot_values,
)
from plumbline.functions.fit_tests import chi2_p_value, ks_p_value
from plumbline.operators.ordering import (
    Cuts,
    collected_ranks,
    exact_quantiles,
    numeric_cuts,
    quantiles_at,
    running_totals,
    wanted_ranks,
    with_held_ranks,
)
from plumbline.operators.stats import as_datetime

EPS = 1e-8
BINS = 10
SEGMENTS = 12  # the surveyed limit, on request
# names of helper columns beside data columns
PERIOD, SEGMENT = "__period", "__segment"
DECILES = [i / BINS for i in range(BINS + 1)]
PSI_FLAG, P_FLAG = 0.2, 0.05


# ------------------------------------------------------------------ expressions
def psi_term(expected: Column, actual: Column, expected_total: Column, actual_total: Column) -> Column:
    """One bin's share of the index; an empty bin counts as EPS."""

    def portion(n: Column, total: Column) -> Column:
        p = n.cast("double") / (total.cast("double") + F.lit(EPS))
        return F.when(p == 0, F.lit(EPS)).otherwise(p)

    e, a = portion(expected, expected_total), portion(actual, actual_total)
    return (e - a) * F.log(e / a)


def bin_edges(quantiles: Column, bins: int = BINS) -> Column:
    """Distinct quantiles, or equal-width edges where fewer than two bins would be left."""
    distinct = F.array_distinct(quantiles)
    low, high = F.array_min(quantiles), F.array_max(quantiles)
    even = F.transform(
        F.sequence(F.lit(0), F.lit(bins)),
        lambda i: F.when(i == bins, high).otherwise(low + (high - low) / F.lit(float(bins)) * i),
    )
    return F.when(F.size(distinct) > 2, distinct).otherwise(even)


def bin_of(value: str, edges: str, bins: int = BINS, open_ends: bool = False) -> Column:
    """0-based bin, the last one closed on the right; NULL outside unless ``open_ends``."""
    passed = " + ".join(f"CASE WHEN {value} >= get({edges}, {i}) THEN 1 ELSE 0 END" for i in range(bins + 1))
    inside = f"greatest(least({passed} - 1, size({edges}) - 2), 0)"
    if open_ends:
        return F.expr(inside)
    return F.expr(f"CASE WHEN {value} >= get({edges}, 0) AND {value} <= get({edges}, size({edges}) - 1) THEN {inside} END")


def unite(baseline: DataFrame, target: DataFrame, names: Sequence[str]) -> DataFrame:
    """Both tables stacked, flagged ``in_base`` / ``in_target``."""
    narrow = [col(n) for n in names]
    b = baseline.select(*narrow, F.lit(True).alias("in_base"), F.lit(False).alias("in_target"))
    t = target.select(*narrow, F.lit(False).alias("in_base"), F.lit(True).alias("in_target"))
    return b.unionByName(t)


def _free(df: DataFrame, *names: str) -> None:
    """Helper columns must not hide data."""
    if taken := [c for c in df.columns if c.lower() in names]:
        raise ValueError(f"reserved column names: {', '.join(taken)}")


def split_by_filter(df: DataFrame, baseline: str, target: str | None = None) -> DataFrame:
    """Flag rows by two predicates in one scan; without ``target`` the rest is the target.
    A row may be on both sides. A malformed predicate raises."""
    _free(df, "in_base", "in_target")
    in_base = F.coalesce(checked_predicate(baseline), F.lit(False))
    in_target = F.coalesce(checked_predicate(target), F.lit(False)) if target else ~in_base
    return df.withColumn("in_base", in_base).withColumn("in_target", in_target)


def checked_predicate(text: str) -> Column:
    if not text or not text.strip():
        raise ValueError("empty filter expression")
    if ";" in text:
        raise ValueError("';' is not allowed in a filter expression")
    return F.expr(text)


def apply_filter(df: DataFrame, predicate: str) -> DataFrame:
    return df.filter(checked_predicate(predicate))


def split_random(df: DataFrame, key: str, seed: int = 0, baseline_tenths: int = 7) -> DataFrame:
    """Seeded 70/30 split by key hash: the same rows on every run and retry."""
    _free(df, "in_base", "in_target")
    lot = F.pmod(F.xxhash64(col(key), F.lit(seed)), F.lit(10))
    return df.withColumn("in_base", lot < baseline_tenths).withColumn("in_target", lot >= baseline_tenths)


def split_by_time(df: DataFrame, time: str, key: str, fraction: float = 0.7) -> DataFrame:
    """The first max(1, floor(fraction * n)) rows by (time, key) are the baseline.

    The cut is one (time, key) pair, found by two small counting jobs, so the split itself is a plain filter on
    constants. Rows without a time come last, ordered by key; ``key`` is a unique whole number and is compared as such.
    """
    _free(df, "in_base", "in_target")
    moment = as_datetime(df.schema[time])
    micros = F.coalesce(F.unix_micros(moment.cast("timestamp")).cast("double"), F.lit(float("inf")))
    keyed = df.select(F.lit("time").alias("column_name"), micros.alias("value"), col(key).alias("key"))

    def at_row(counted: DataFrame, sample: DataFrame, wanted: Column):
        """The value that holds the wanted place, and how many of its rows are wanted."""
        ranked = running_totals(counted, ["column_name"], ["n"], numeric_cuts(sample))
        before = F.col("cum_n") - F.col("n")
        return ranked.filter((before < wanted) & (wanted <= F.col("cum_n"))).select("value", (wanted - before).alias("taken")).first()

    finite = keyed.filter(F.col("value") < float("inf"))
    counted = keyed.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    edge = at_row(counted, finite, F.greatest(F.lit(1), F.floor(F.col("total_n") * F.lit(fraction))))
    if edge is None:  # no rows
        return df.withColumn("in_base", F.lit(False)).withColumn("in_target", F.lit(True))
    tied = keyed.filter(F.col("value") == edge["value"]).select("column_name", F.col("key").alias("value"))
    # doubles cut the ranges, which are monotone in the key; inside a range the keys are sorted as they are
    ties = tied.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    last = at_row(ties, tied.withColumn("value", F.col("value").cast("double")), F.lit(edge["taken"]))
    first = (micros < edge["value"]) | ((micros == edge["value"]) & (col(key) <= F.lit(last["value"])))
    return df.withColumn("in_base", first).withColumn("in_target", ~first)


# --------------------------------------------------------------- numeric measures
def numeric_side_counts(sided: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column_name, value, nb, nt) over rows flagged in_base / in_target."""
    long = numeric_long(sided, names, keep=["in_base", "in_target"])
    return long.groupBy("column_name", "value").agg(
        F.count_if("in_base").alias("nb"), F.count_if("in_target").alias("nt")
    )


def _ks_gap() -> Column:
    return F.abs(share(F.col("cum_nb"), F.col("total_nb")) - share(F.col("cum_nt"), F.col("total_nt")))


def ks_two_sample(sided: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column_name, ks_stat, ks_p, baseline_n, target_n)."""
    counts, cuts = numeric_side_counts(sided, names), numeric_cuts(numeric_long(sided, names))
    ranked = running_totals(counts, ["column_name"], ["nb", "nt"], cuts)
    measured = ranked.groupBy("column_name").agg(
        F.max(_ks_gap()).alias("ks_stat"), F.max("total_nb").alias("baseline_n"), F.max("total_nt").alias("target_n")
    )
    p = ks_p_value(F.col("ks_stat"), F.col("baseline_n"), F.col("target_n"))
    return measured.select("column_name", "ks_stat", p.alias("ks_p"), "baseline_n", "target_n")


def _psi_of_bins(per_bin: DataFrame, keys: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """Index per key from (keys, bin, e, a); a NULL bin is outside the edges. Also
    gives the sizes en, an and the target rows inside. At most 11 rows per key."""
    whole = Window.partitionBy(*keys)
    inside = F.col("bin").isNotNull()
    summed = per_bin.withColumns(
        {side + "t": F.sum(F.when(inside, F.col(side)).otherwise(0)).over(whole) for side in ("e", "a")}
    )
    term = psi_term(F.col("e"), F.col("a"), F.col("et"), F.col("at"))
    return summed.groupBy(*keys).agg(
        F.sum(F.when(inside, term)).alias("psi"),
        F.sum("e").alias("en"),
        F.sum("a").alias("an"),
        F.max("at").alias("a_inside"),
        *[F.max(c).alias(c) for c in carried],
    )


def _psi_from_counts(
    counts: DataFrame, edges: DataFrame, open_ends: bool, carried: Sequence[str] = ()
) -> DataFrame:
    """``counts`` (column_name, value, nb, nt) against ``edges`` (column_name, edges, carried...)."""
    binned = counts.join(F.broadcast(edges), "column_name").withColumn(  # one row per column
        "bin", bin_of("value", "edges", open_ends=open_ends)
    )
    per_bin = binned.groupBy("column_name", "bin").agg(
        F.sum("nb").alias("e"), F.sum("nt").alias("a"), *[F.max(c).alias(c) for c in carried]
    )
    summed = _psi_of_bins(per_bin, ["column_name"], carried)
    # an empty side has no index
    both = (F.col("en") > 0) & (F.col("an") > 0)
    return summed.select(
        "column_name",
        F.when(both, F.col("psi")).alias("psi"),
        (100 * share(F.col("an") - F.col("a_inside"), F.col("an"))).alias("out_of_range_pct"),
        *carried,
    )


def psi_numeric(sided: DataFrame, names: Sequence[str], open_ends: bool = False) -> DataFrame:
    """PSI over the baseline's distinct deciles. Target values outside the baseline
    range are left out unless ``open_ends``; their share is reported."""
    long = numeric_long(sided, names, keep=["in_base", "in_target"])
    base = long.filter("in_base").select("column_name", "value")
    quantiles = exact_quantiles(base, ["column_name"], DECILES)
    edges = quantiles.select("column_name", bin_edges(F.col("quantiles")).alias("edges"))
    counts = long.select(
        "column_name", "value", F.col("in_base").cast("int").alias("nb"), F.col("in_target").cast("int").alias("nt")
    )
    return _psi_from_counts(counts, edges, open_ends)


def psi_profile(baseline: DataFrame, current: DataFrame, names: Sequence[str]) -> DataFrame:
    """The profiler's PSI: deciles are kept with repeats, both bin ends are closed,
    bins empty on either side are skipped. Bins overlap, so each is counted by its own condition."""
    sided = unite(baseline, current, names)
    long = numeric_long(sided, names, keep=["in_base", "in_target"])
    base = long.filter("in_base").select("column_name", "value")
    edges = exact_quantiles(base, ["column_name"], DECILES).select("column_name", F.col("quantiles").alias("q"))
    q = [F.get("q", F.lit(i)) for i in range(BINS + 1)]
    counted = (
        long.join(F.broadcast(edges), "column_name")
        .groupBy("column_name")
        .agg(
            F.count_if("in_base").alias("bn"),
            F.count_if("in_target").alias("tn"),
            *[
                F.count_if(F.col(side) & F.col("value").between(q[i], q[i + 1])).alias(f"{side}_{i}")
                for i in range(BINS)
                for side in ("in_base", "in_target")
            ],
        )
    )
    psi = F.lit(0.0)
    for i in range(BINS):
        e, a = share(F.col(f"in_base_{i}"), F.col("bn")), share(F.col(f"in_target_{i}"), F.col("tn"))
        psi = psi + F.when((e > 0) & (a > 0), (e - a) * F.log(e / a)).otherwise(0.0)
    return counted.select("column_name", F.when((F.col("bn") > 0) & (F.col("tn") > 0), psi).alias("psi_profile"))


# ----------------------------------------------------------- categorical measures
def category_side_counts(sided: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column_name, value, nb, nt); missing values are the category __NA__."""
    long = unpivot_values(sided, names, as_text, keep=["in_base", "in_target"])
    return (
        long.withColumn("value", F.coalesce("value", F.lit(MISSING_LABEL)))
        .groupBy("column_name", "value")
        .agg(F.count_if("in_base").alias("nb"), F.count_if("in_target").alias("nt"))
        .filter((F.col("nb") > 0) | (F.col("nt") > 0))
    )


def _category_measures(counts: DataFrame, keys: Sequence[str] = ("column_name",)) -> DataFrame:
    """chi2, dof and textbook PSI per key from (keys, value, nb, nt)."""
    keys = list(keys)
    totals = counts.groupBy(*keys).agg(F.sum("nb").alias("bt"), F.sum("nt").alias("tt"))
    row = F.col("nb") + F.col("nt")
    whole = F.col("bt") + F.col("tt")
    expected_b, expected_t = row * share(F.col("bt"), whole), row * share(F.col("tt"), whole)
    chi2 = (F.col("nb") - expected_b) ** 2 / F.nullif(expected_b, F.lit(0.0)) + (
        F.col("nt") - expected_t
    ) ** 2 / F.nullif(expected_t, F.lit(0.0))
    term = psi_term(F.col("nb"), F.col("nt"), F.col("bt"), F.col("tt"))
    joined = counts.join(F.broadcast(totals), keys)  # one row per key: columns, column pairs of months or 12 groups
    both = (F.max("bt") > 0) & (F.max("tt") > 0)
    return joined.groupBy(*keys).agg(
        F.when(both, F.sum(chi2)).alias("chi2"),
        F.when(both, F.count("*") - 1).alias("dof"),
        F.when(both, F.sum(term)).alias("psi"),
        F.max("bt").alias("baseline_n"),
        F.max("tt").alias("target_n"),
    )


def chi2_two_sample(sided: DataFrame, names: Sequence[str]) -> DataFrame:
    measured = _category_measures(category_side_counts(sided, names))
    return measured.select("column_name", "chi2", "dof", chi2_p_value("chi2", "dof").alias("chi2_p"))


def psi_categorical(sided: DataFrame, names: Sequence[str]) -> DataFrame:
    return _category_measures(category_side_counts(sided, names)).select(
        "column_name", "psi", "baseline_n", "target_n"
    )


def psi_share_hist(sided: DataFrame, names: Sequence[str]) -> DataFrame:
    """Compatibility measure: PSI of the histogram of the category *shares*.

    Categories with the same count are one row here. Distinct counts add up to
    at most the row count N, so there are at most sqrt(2 N) rows per column and a
    window per column stays small (1.4 million rows for 10^12 rows of data).
    """
    counts = category_side_counts(sided, names)
    totals = counts.groupBy("column_name").agg(
        F.sum("nb").alias("bt"), F.sum("nt").alias("tt"), F.count("*").alias("k")
    )
    by_share_b = counts.groupBy("column_name", F.col("nb").alias("c")).agg(F.count("*").alias("m"))
    by_share_t = counts.groupBy("column_name", F.col("nt").alias("c")).agg(F.count("*").alias("m"))
    small = F.broadcast(totals)
    b = by_share_b.join(small, "column_name").select(
        "column_name", "m", "k", share(F.col("c"), F.col("bt")).alias("s")
    )
    t = by_share_t.join(small, "column_name").select("column_name", "m", "k", share(F.col("c"), F.col("tt")).alias("s"))
    w = Window.partitionBy("column_name").orderBy("s")
    walked = b.select(
        "*",
        F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"),
        F.lead("s").over(w).alias("next"),
        F.row_number().over(w).alias("place"),
    )
    # of k + 1 evenly spaced quantiles over k sorted shares, the c-th lies between
    # the c-th and the next share; repeats of a share give edges at the share itself
    buckets = F.greatest(F.col("k"), F.lit(2))
    position = F.col("cum") * (F.col("k") - 1) / buckets.cast("double")
    between = F.col("s") + (F.col("next") - F.col("s")) * (position - F.floor(position))
    own = F.when((F.col("m") >= 2) | (F.col("place") == 1) | F.col("next").isNull(), F.col("s"))
    edge_rows = (
        walked.filter(F.col("k") >= 2)
        .select("column_name", F.explode(F.array_compact(F.array(own, between))).alias("s"))
        .distinct()
    )
    edge_stats = edge_rows.groupBy("column_name").agg(
        F.count("*").alias("n_edges"), F.min("s").alias("low"), F.max("s").alias("high")
    )
    kept = edge_rows.join(
        F.broadcast(edge_stats.filter(F.col("n_edges") > 2).select("column_name")), "column_name", "left_semi"
    )
    edges = kept.select("column_name", "s", F.lit(1).alias("edge"), F.lit(0).alias("e"), F.lit(0).alias("a"))
    shares = b.select("column_name", "s", F.lit(0).alias("edge"), F.col("m").alias("e"), F.lit(0).alias("a")).unionByName(
        t.select("column_name", "s", F.lit(0).alias("edge"), F.lit(0).alias("e"), F.col("m").alias("a"))
    )
    spaced = F.broadcast(edge_stats.filter(F.col("n_edges") <= 2))  # one row per column
    points = shares.join(spaced, "column_name", "left_anti")
    # at most two edges: evenly spaced ones take their place, and a share's bin is arithmetic
    buckets = F.greatest(F.col("k"), F.lit(2))
    edge_at = lambda i: F.col("low") + (F.col("high") - F.col("low")) / buckets * i
    near = shares.join(spaced, "column_name").join(small.select("column_name", "k"), "column_name").filter((F.col("s") >= F.col("low")) & (F.col("s") <= F.col("high")))
    guess = F.coalesce(F.floor((F.col("s") - F.col("low")) * buckets / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))), F.lit(0))
    near = near.withColumn("i", guess)
    near = near.withColumn("i", F.when(edge_at(F.col("i")) > F.col("s"), F.col("i") - 1).when(edge_at(F.col("i") + 1) <= F.col("s"), F.col("i") + 1).otherwise(F.col("i")))
    near = near.select("column_name", (F.when(F.col("low") == F.col("high"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.col("i"), buckets - 1))) + 1).alias("bin"), "e", "a")
    merged = edges.unionByName(points).groupBy("column_name", "s").agg(
        F.sum("edge").alias("edge"), F.sum("e").alias("e"), F.sum("a").alias("a")
    )
    whole = Window.partitionBy("column_name")
    placed = merged.select(
        "*",
        F.sum("edge").over(whole.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)).alias("passed"),
        F.sum("edge").over(whole).alias("edges"),
    ).withColumn(
        "bin",
        F.when(F.col("passed") == 0, None)
        .when((F.col("passed") == F.col("edges")) & (F.col("edge") == 1) & (F.col("edges") > 1), F.col("edges") - 1)
        .when((F.col("passed") == F.col("edges")) & (F.col("edge") == 0), None)
        .otherwise(F.col("passed")),
    )
    binned = placed.filter(F.col("bin").isNotNull()).select("column_name", "bin", "e", "a").unionByName(near)
    per_bin = binned.groupBy("column_name", "bin").agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    sums = per_bin.groupBy("column_name").agg(F.sum("e").alias("et"), F.sum("a").alias("at"))
    term = psi_term(F.col("e"), F.col("a"), F.col("et"), F.col("at"))
    summed = per_bin.join(F.broadcast(sums), "column_name").groupBy("column_name").agg(F.sum(term).alias("psi_share_hist"))
    # a single category has equal shares on both sides: no drift by this measure
    return totals.join(F.broadcast(summed), "column_name", "left").select(
        "column_name",
        F.when((F.col("bt") > 0) & (F.col("tt") > 0), F.coalesce("psi_share_hist", F.lit(0.0))).alias("psi_share_hist"),
    )


# --------------------------------------------------------------------- population
RECORD = "column_name string, type string, ks_stat double, ks_p double, chi2 double, dof bigint, chi2_p double, psi double, out_of_range_pct double, baseline_n bigint, target_n bigint"


def auto_columns(df: DataFrame, max_levels: int = 50) -> list[str]:
    """The first two numeric columns, else the first two categorical ones with at most ``max_levels`` values.

    Without numeric columns a sketch in one scan rules out free text; only near the limit are values counted exactly.
    """
    numeric = of_kind(df, "numeric")
    if numeric:
        return numeric[:2]
    texts, chosen = of_kind(df, "text"), []
    if not texts:
        return []
    about = df.agg(*[F.approx_count_distinct(col(n)).alias(f"n{i}") for i, n in enumerate(texts)]).first()
    for name, n in zip(texts, about):
        if len(chosen) < 2 and n <= 2 * max_levels and df.select(col(name)).dropna().distinct().count() <= max_levels:
            chosen.append(name)
    return chosen


def drift_population(
    sided: DataFrame, names: Sequence[str] | None = None, prefer_type: str = "auto", open_ends: bool = False, share_hist: bool = False
) -> DataFrame:
    """One record per column; ``sided`` carries in_base / in_target. ``share_hist`` adds the compatibility measure of
    categories (see ``psi_share_hist``) beside the index."""
    if prefer_type not in ("auto", "numeric", "categorical"):
        raise ValueError(f"unknown prefer_type {prefer_type!r}")
    data = sided.drop("in_base", "in_target")
    names = list(names) if names else auto_columns(data)
    numeric = [
        n for n in names if prefer_type == "numeric" or (prefer_type == "auto" and kind(data.schema[n].dataType) == "numeric")
    ]
    textual = [n for n in names if n not in numeric]
    parts = []
    if numeric:
        # one counting shuffle feeds the running totals and the bins; the deciles are
        # read off the running totals in the aggregate that takes the KS distance
        counts = numeric_side_counts(sided, numeric)
        cuts = numeric_cuts(numeric_long(sided, numeric))
        ranked = running_totals(counts, ["column_name"], ["nb", "nt"], cuts).withColumn(
            "ranks", F.expr(wanted_ranks(DECILES, "total_nb"))
        )
        held = with_held_ranks(ranked, "ranks", "cum_nb - nb", "cum_nb", len(DECILES))
        measured = held.groupBy("column_name").agg(
            F.max(_ks_gap()).alias("ks_stat"),
            F.max("total_nb").alias("baseline_n"),
            F.max("total_nt").alias("target_n"),
            collected_ranks().alias("at"),
        )
        edges = measured.select(
            "column_name",
            "ks_stat",
            "baseline_n",
            "target_n",
            bin_edges(quantiles_at(DECILES, "at", "baseline_n")).alias("edges"),
        )
        joined = _psi_from_counts(counts, edges, open_ends, ["ks_stat", "baseline_n", "target_n"])
        parts.append(
            joined.select(
                "column_name",
                F.lit("numeric").alias("type"),
                "ks_stat",
                ks_p_value(F.col("ks_stat"), F.col("baseline_n"), F.col("target_n")).alias("ks_p"),
                F.lit(None).cast("double").alias("chi2"),
                F.lit(None).cast("bigint").alias("dof"),
                F.lit(None).cast("double").alias("chi2_p"),
                "psi",
                "out_of_range_pct",
                "baseline_n",
                "target_n",
            )
        )
    if textual:
        measured = _category_measures(category_side_counts(sided, textual))
        parts.append(
            measured.select(
                "column_name",
                F.lit("categorical").alias("type"),
                F.lit(None).cast("double").alias("ks_stat"),
                F.lit(None).cast("double").alias("ks_p"),
                "chi2",
                "dof",
                chi2_p_value("chi2", "dof").alias("chi2_p"),
                "psi",
                F.lit(None).cast("double").alias("out_of_range_pct"),
                "baseline_n",
                "target_n",
            )
        )
    if not parts:
        return sided.sparkSession.createDataFrame([], RECORD)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if share_hist:
        if textual:
            return out.join(F.broadcast(psi_share_hist(sided, textual)), "column_name", "left")  # one row per column
        return out.withColumn("psi_share_hist", F.lit(None).cast("double"))
    return out


def with_flags(records: DataFrame) -> DataFrame:
    def over(name: str, test) -> Column:
        return F.coalesce(test(F.col(name)), F.lit(False)) if name in records.columns else F.lit(False)

    return records.withColumn(
        "flagged",
        over("psi", lambda c: c > PSI_FLAG) | over("ks_p", lambda c: c < P_FLAG) | over("chi2_p", lambda c: c < P_FLAG),
    )


def drift_summary(flagged: DataFrame) -> DataFrame:
    """Number of records and the flagged columns. The records are a small table."""
    return flagged.agg(
        F.count("*").alias("n_records"),
        F.count_if("flagged").alias("n_flagged"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("flagged"), F.col("column_name")))), ", ").alias(
            "flagged_columns"
        ),
    )


# ----------------------------------------------------------------------- temporal
def _months(df: DataFrame, time: str) -> DataFrame:
    _free(df, PERIOD)
    return df.withColumn(PERIOD, F.date_format(as_datetime(df.schema[time]), "yyyy-MM")).filter(F.col(PERIOD).isNotNull())


def _month_pairs(monthly: DataFrame) -> DataFrame:
    """(period, previous, following) over observed months: a calendar-sized table."""
    w = Window.partitionBy().orderBy("period")
    return monthly.select(F.col(PERIOD).alias("period")).distinct().select(
        "period", F.lag("period").over(w).alias("previous"), F.lead("period").over(w).alias("following")
    )


def psi_series(df: DataFrame, time: str, names: Sequence[str]) -> DataFrame:
    """(column_name, period, psi) for each month against the month observed before it."""
    monthly = _months(df, time)
    pairs = _month_pairs(monthly)
    numeric = [n for n in names if kind(df.schema[n].dataType) == "numeric"]
    textual = [n for n in names if n not in numeric]
    parts = []
    if numeric:
        parts.append(_numeric_series(monthly, pairs, numeric))
    if textual:
        parts.append(_category_series(monthly, pairs, textual))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    later = pairs.filter(F.col("previous").isNotNull()).select(
        "period", F.explode(F.array(*[F.lit(n) for n in names])).alias("column_name")
    )
    return later.join(found, ["column_name", "period"], "left").select("column_name", "period", "psi")


def _numeric_series(monthly: DataFrame, pairs: DataFrame, names: Sequence[str]) -> DataFrame:
    long = numeric_long(monthly, names, keep=[PERIOD]).withColumnRenamed(PERIOD, "period")
    cuts = numeric_cuts(long.select("column_name", "value"))
    counts = long.groupBy("column_name", "period", "value").agg(F.count("*").alias("n"))
    months = F.broadcast(pairs)  # one row per calendar month
    edges = exact_quantiles(counts, ["column_name", "period"], DECILES, cuts, weight="n").select(
        "column_name", "period", bin_edges(F.col("quantiles")).alias("edges")
    )
    # a month's values play two parts: expected against their own deciles for the
    # month that follows, actual against the deciles of the month before
    roles = counts.join(months, "period").select(
        "column_name",
        "value",
        "n",
        F.explode(
            F.array(
                F.struct(F.lit(True).alias("expected"), F.col("period").alias("edge_period"), F.col("following").alias("pair")),
                F.struct(F.lit(False).alias("expected"), F.col("previous").alias("edge_period"), F.col("period").alias("pair")),
            )
        ).alias("r"),
    ).select("column_name", "value", "n", "r.*").filter(F.col("edge_period").isNotNull() & F.col("pair").isNotNull())
    small = F.broadcast(edges.withColumnRenamed("period", "edge_period"))  # columns x months rows
    binned = roles.join(small, ["column_name", "edge_period"]).withColumn(
        "bin", bin_of("value", "edges")
    )
    per_bin = (
        binned.groupBy("column_name", "pair", "bin")
        .agg(
            F.coalesce(F.sum(F.when(F.col("expected"), F.col("n"))), F.lit(0)).alias("e"),
            F.coalesce(F.sum(F.when(~F.col("expected"), F.col("n"))), F.lit(0)).alias("a"),
        )
    )
    summed = _psi_of_bins(per_bin, ["column_name", "pair"])
    return summed.filter((F.col("en") > 0) & (F.col("an") > 0)).select(
        "column_name", F.col("pair").alias("period"), "psi"
    )


def _category_series(monthly: DataFrame, pairs: DataFrame, names: Sequence[str]) -> DataFrame:
    """Missing values are left out over time; the index is the textbook one."""
    long = unpivot_values(monthly, names, as_text, keep=[PERIOD]).withColumnRenamed(PERIOD, "period").filter(F.col("value").isNotNull())
    counts = long.groupBy("column_name", "period", "value").agg(F.count("*").alias("n"))
    roles = counts.join(F.broadcast(pairs), "period").select(
        "column_name",
        "value",
        F.explode(
            F.array(
                F.struct(F.col("following").alias("pair"), F.col("n").alias("nb"), F.lit(0).cast("bigint").alias("nt")),
                F.struct(
                    F.when(F.col("previous").isNotNull(), F.col("period")).alias("pair"),
                    F.lit(0).cast("bigint").alias("nb"),
                    F.col("n").alias("nt"),
                ),
            )
        ).alias("r"),
    ).select("column_name", "value", "r.*").filter(F.col("pair").isNotNull())
    sides = roles.groupBy("column_name", "pair", "value").agg(F.sum("nb").alias("nb"), F.sum("nt").alias("nt"))
    measured = _category_measures(sides, ["column_name", "pair"])
    return measured.select("column_name", F.col("pair").alias("period"), "psi")


def drift_temporal(df: DataFrame, time: str, names: Sequence[str]) -> DataFrame:
    """avg, max and number of month-to-month indices per column."""
    series = psi_series(df, time, names)
    return (
        series.groupBy("column_name")
        .agg(
            F.avg("psi").alias("avg_psi"),
            F.max("psi").alias("max_psi"),
            F.count("*").alias("periods_analyzed"),
        )
        .filter(F.col("avg_psi").isNotNull())
        .select(
            "column_name",
            F.lit("temporal").alias("type"),
            F.lit("psi_over_time").alias("metric"),
            "avg_psi",
            "max_psi",
            "periods_analyzed",
        )
    )


def drift_over_time(df: DataFrame, time: str, names: Sequence[str], key: str, seed: int = 0) -> DataFrame:
    """``drift_temporal``, or the seeded 70/30 population drift where only one month is observed."""
    monthly = _months(df, time)
    # two months are enough to know; the answer is one bounded number
    if monthly.agg(F.min(PERIOD) < F.max(PERIOD)).first()[0]:
        return drift_temporal(df, time, names)
    return drift_population(split_random(monthly.drop(PERIOD), key, seed), names)


# ------------------------------------------------------------------------ segment
def top_groups(df: DataFrame, group: str, k: int = SEGMENTS) -> DataFrame:
    """The k largest groups, ties by name; a missing group is __NA__."""
    labelled = df.select(F.coalesce(as_text(df.schema[group]), F.lit(MISSING_LABEL)).alias("segment"))
    counted = labelled.groupBy("segment").agg(F.count("*").alias("rows"))
    return counted.orderBy(F.desc("rows"), "segment").limit(k)


def drift_segment(df: DataFrame, group: str, names: Sequence[str], k: int | None = None) -> DataFrame:
    """Each group (baseline) against all other rows (target); with ``k`` only the k largest groups.

    Values are counted once per (column, segment, value); the rest of a group is the column's total less the group, so
    nothing is multiplied by the number of groups.
    """
    _free(df, SEGMENT)
    label = F.coalesce(as_text(df.schema[group]), F.lit(MISSING_LABEL))
    labelled = df.withColumn(SEGMENT, label)
    if k is not None:
        chosen = top_groups(df, group, k).select(F.col("segment").alias(SEGMENT), F.lit(True).alias("__kept"))  # k rows
        labelled = labelled.join(F.broadcast(chosen), SEGMENT, "left").withColumn(SEGMENT, F.when(F.col("__kept"), F.col(SEGMENT))).drop("__kept")
    numeric = [n for n in names if kind(df.schema[n].dataType) == "numeric"]
    textual = [n for n in names if n not in numeric]
    parts = []
    if numeric:
        parts.append(_numeric_segments(labelled, numeric))
    if textual:
        parts.append(_category_segments(labelled, textual))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _numeric_segments(labelled: DataFrame, names: Sequence[str]) -> DataFrame:
    long = numeric_long(labelled, names, keep=[SEGMENT]).withColumnRenamed(SEGMENT, "segment")
    cuts: Cuts = numeric_cuts(long.select("column_name", "value"))
    counts = long.groupBy("column_name", "segment", "value").agg(F.count("*").alias("n"))
    kept = counts.filter(F.col("segment").isNotNull())
    keys = ["column_name", "segment"]
    grouped = running_totals(kept, keys, ["n"], cuts)
    ranked = grouped.withColumn("ranks", F.expr(wanted_ranks(DECILES, "total_n")))
    held = with_held_ranks(ranked, "ranks", "cum_n - n", "cum_n", len(DECILES))
    deciles = held.groupBy(*keys).agg(F.max("total_n").alias("baseline_n"), collected_ranks().alias("at"))
    edged = deciles.select(*keys, bin_edges(quantiles_at(DECILES, "at", "baseline_n")).alias("edges"))
    # One running total over all rows serves both the gaps and the bins: the groups' edges, at most 11 each, are marks in it.
    edges = edged.select(*keys, F.posexplode("edges").alias("place", "value"))
    marks = edges.select("column_name", "value", F.lit(0).cast("bigint").alias("n"))
    column_counts = counts.select("column_name", "value", "n").unionByName(marks).groupBy("column_name", "value").agg(F.sum("n").alias("t"))
    overall = running_totals(column_counts, ["column_name"], ["t"], cuts)
    both = grouped.join(overall, ["column_name", "value"])
    target_n = F.col("total_t") - F.col("total_n")

    # between two values of the group only the rest moves, so the gap is widest
    # right at a value of the group or right before it
    def gap(group_cum: Column, all_cum: Column) -> Column:
        return F.abs(share(group_cum, F.col("total_n")) - share(all_cum - group_cum, target_n))

    at = gap(F.col("cum_n"), F.col("cum_t"))
    before = gap(F.col("cum_n") - F.col("n"), F.col("cum_t") - F.col("t"))
    measured = both.groupBy(*keys).agg(
        F.max(F.greatest(at, before)).alias("ks_stat"), F.max("total_n").alias("baseline_n"), F.max(target_n).alias("target_n")
    )
    # A group's own rows are binned at its edges; of all rows a bin holds the difference of the totals at its two ends.
    own = kept.join(edged, keys).groupBy(*keys, bin_of("value", "edges").alias("bin")).agg(F.sum("n").alias("e"))
    step = Window.partitionBy(*keys).orderBy("place")
    read = edges.join(overall.select("column_name", "value", "t", "cum_t"), ["column_name", "value"])
    closed = F.lead("place").over(step).isNull()  # the last edge takes the rows at it
    ends = read.select(*keys, "place", F.when(closed, F.col("cum_t")).otherwise(F.col("cum_t") - F.col("t")).alias("everyone"))
    # A constant column's edges are equal: its rows lie in the last bin.
    bins = ends.select(*keys, (F.col("place") - 1).alias("bin"), (F.col("everyone") - F.lag("everyone").over(step)).alias("all_in")).filter("bin >= 0 AND all_in > 0")
    filled = bins.join(own, [*keys, "bin"], "left").withColumn("e", F.coalesce("e", F.lit(0)))
    per_bin = filled.join(measured, keys).withColumn("a", F.col("all_in") - F.col("e"))
    indexed = _psi_of_bins(per_bin, keys, ["ks_stat", "baseline_n", "target_n"])
    return indexed.filter((F.col("baseline_n") > 0) & (F.col("target_n") > 0)).select(
        "column_name",
        "segment",
        F.lit("numeric_segment").alias("type"),
        "ks_stat",
        ks_p_value(F.col("ks_stat"), F.col("baseline_n"), F.col("target_n")).alias("ks_p"),
        F.lit(None).cast("double").alias("chi2"),
        F.lit(None).cast("bigint").alias("dof"),
        F.lit(None).cast("double").alias("chi2_p"),
        "psi",
        "baseline_n",
        "target_n",
    )


def _category_segments(labelled: DataFrame, names: Sequence[str]) -> DataFrame:
    """Chi-square and index of each group against the rest from the observed (group, category) rows alone.

    With n rows of a category in the group, t in all, B and T rows in the group and the rest, N = B + T, both measures
    are sums over categories. A category that the group lacks has n = 0, so its terms depend on t alone: their sum is
    the column's total less that of the observed categories, and no row stands for it.
    """
    long = unpivot_values(labelled, names, as_text, keep=[SEGMENT]).withColumnRenamed(SEGMENT, "segment").filter(F.col("value").isNotNull())
    counts = long.groupBy("column_name", "segment", "value").agg(F.count("*").alias("n"))
    column_counts = counts.groupBy("column_name", "value").agg(F.sum("n").alias("t"))
    n, t = F.col("n").cast("double"), F.col("t").cast("double")
    columns = column_counts.groupBy("column_name").agg(
        F.sum("t").alias("column_n"), F.count("*").alias("kinds"), F.sum(F.log(t)).alias("all_log"), F.sum(t * F.log(t)).alias("all_tlog")
    )
    rest, alone = t - n, F.col("t") == F.col("n")  # alone: only this group has the category
    ratio = F.when(~alone, F.log(n / F.nullif(rest, F.lit(0.0))))

    def total(c: Column, name: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0.0)).alias(name)

    sums = counts.filter(F.col("segment").isNotNull()).join(column_counts, ["column_name", "value"]).groupBy("column_name", "segment").agg(
        F.sum("n").alias("own_n"), F.count("*").alias("kinds_seen"), F.sum("t").alias("rows_seen"), F.sum(n * n / t).alias("squares"),
        total(n * ratio, "n_ratio"), total(rest * ratio, "rest_ratio"), total(F.when(~alone, n), "n_both"), total(F.when(~alone, rest), "rest_both"),
        total(F.when(alone, n * F.log(n)), "n_log"), total(F.when(alone, F.log(n)), "log"), total(F.when(alone, n), "n_alone"), F.count_if(alone).alias("k_alone"),
        F.sum(F.log(t)).alias("seen_log"), F.sum(t * F.log(t)).alias("seen_tlog"),
    )
    c = sums.join(F.broadcast(columns), "column_name").withColumn("rest_n", F.col("column_n") - F.col("own_n")).filter((F.col("own_n") > 0) & (F.col("rest_n") > 0))  # one row per column
    B, T, N = (F.col(x).cast("double") for x in ("own_n", "rest_n", "column_n"))
    chi2 = F.greatest(F.lit(0.0), N * N / (B * T) * (F.col("squares") - B * B / N))
    # The index is the sum of (e - a) log(e / a) over the categories' shares e of the group and a of the rest, EPS where
    # there are none; written out in sums for categories of both sides, of the group alone, and of the rest alone.
    b, r, eps, log_eps = B + F.lit(EPS), T + F.lit(EPS), F.lit(EPS), F.lit(math.log(EPS))
    both = F.col("n_ratio") / b - F.col("rest_ratio") / r + F.log(r / b) * (F.col("n_both") / b - F.col("rest_both") / r)
    own = (F.col("n_log") - F.col("n_alone") * (F.log(b) + log_eps)) / b - eps * (F.col("log") - F.col("k_alone") * (F.log(b) + log_eps))
    m, absent = (F.col("kinds") - F.col("kinds_seen")).cast("double"), (F.col("column_n") - F.col("rows_seen")).cast("double")
    lacking = (
        m * eps * log_eps - eps * (F.col("all_log") - F.col("seen_log") - m * F.log(r)) - log_eps * absent / r
        + (F.col("all_tlog") - F.col("seen_tlog") - absent * F.log(r)) / r
    )
    psi = both + own + F.when(m > 0, lacking).otherwise(F.lit(0.0))
    return c.select(
        "column_name",
        "segment",
        F.lit("categorical_segment").alias("type"),
        F.lit(None).cast("double").alias("ks_stat"),
        F.lit(None).cast("double").alias("ks_p"),
        chi2.alias("chi2"),
        (F.col("kinds") - 1).alias("dof"),
        chi2_p_value(chi2, F.col("kinds") - 1).alias("chi2_p"),
        psi.alias("psi"),
        F.col("own_n").alias("baseline_n"),
        F.col("rest_n").alias("target_n"),
    )
