"""Outlier rates, and the isolation forest on planted extremes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.columns import numeric_long
from plumbline.operators import isolation, outliers

RNG = np.random.default_rng(11)


@pytest.fixture(scope="module")
def planted(spark):
    values = RNG.normal(size=4000)
    values[:40] = 60 + RNG.random(40) * 40
    return values, spark.createDataFrame([(i, float(v), 1.0) for i, v in enumerate(values)], "k bigint, x double, flat double")


def test_z_and_fences(planted):
    values, df = planted
    z = {r["column_name"]: r["outlier_z"] for r in outliers.zscore_rates(df, ["x", "flat"]).collect()}
    assert z["x"] == (np.abs((values - values.mean()) / values.std()) > 3).mean() and z["flat"] == 0
    q1, q3 = np.percentile(values, [25, 75])
    mask = (values < q1 - 1.5 * (q3 - q1)) | (values > q3 + 1.5 * (q3 - q1))
    iqr = {r["column_name"]: r["outlier_iqr"] for r in outliers.iqr_rates(df, ["x", "flat"]).collect()}
    assert abs(iqr["x"] - mask.mean()) < 1e-12 and iqr["flat"] == 0
    assert outliers.outlier_rows(df, "x").count() == mask.sum()
    assert outliers.outlier_rows(df, "x", method="z").count() == round(z["x"] * len(values))
    near = {r["column_name"]: r["outlier_iqr"] for r in outliers.iqr_rates(df, ["x"], approx=True).collect()}
    assert abs(near["x"] - mask.mean()) < 0.01


def test_fewer_than_ten_values_have_no_outliers(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0] * 8 + [1e9])], "k bigint, x double")
    assert outliers.zscore_rates(df, ["x"]).first()["outlier_z"] == 0
    assert outliers.iqr_rates(df, ["x"]).first()["outlier_iqr"] == 0
    assert outliers.forest_rates(df, ["x"], "k").first()["outlier_iso"] == 0


def test_forest_flags_planted_extremes(planted):
    values, df = planted
    long = numeric_long(df, ["x"], keep=["k"])
    scored = isolation.with_score(long, isolation.forest_steps(long))
    rows = {r["k"]: r["score"] for r in scored.collect()}
    assert len(rows) == len(values)
    far, near = np.mean([rows[i] for i in range(40)]), np.mean([rows[i] for i in range(40, 4000)])
    assert far > 0.7 > near and min(rows[i] for i in range(40)) > 0.5
    assert 0 < min(rows.values()) and max(rows.values()) <= 1


def test_forest_rates(planted):
    _, df = planted
    auto = {r["column_name"]: r["outlier_iso"] for r in outliers.forest_rates(df, ["x", "flat"], "k").collect()}
    assert 0.01 <= auto["x"] <= 0.5 and auto["flat"] == 0
    fixed = outliers.forest_rates(df, ["x"], "k", contamination=0.05).first()["outlier_iso"]
    assert 0.03 <= fixed <= 0.05
    again = outliers.forest_rates(df.repartition(3), ["x", "flat"], "k")
    assert {r["column_name"]: r["outlier_iso"] for r in again.collect()} == auto


def test_tree_covers_the_line():
    values = np.sort(RNG.normal(size=256))
    leaves = isolation.grow(values, np.random.default_rng(1))
    bounds = [b for b, _ in leaves]
    assert bounds == sorted(bounds) and bounds[-1] == np.inf
    assert isolation.grow(np.array([2.0]), RNG) == [(np.inf, 0.0)]
    assert isolation.grow(np.full(9, 2.0), RNG) == [(np.inf, isolation.mean_path(9))]


def test_step_function_matches_the_trees(spark):
    """The folded steps give the same mean path as walking every tree."""
    values = RNG.normal(size=200)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "k bigint, x double")
    long = numeric_long(df, ["x"], keep=["k"])
    steps = isolation.forest_steps(long, seed=9)
    trees = [
        isolation.grow(np.sort(values), np.random.default_rng(9 * 1_000_003 + t)) for t in range(isolation.TREES)
    ]
    got = {r["k"]: r["score"] for r in isolation.with_score(long, steps).collect()}
    for i, v in enumerate(values):
        paths = [next(length for bound, length in t if v <= bound) for t in trees]
        assert abs(got[i] - 2 ** (-np.mean(paths) / isolation.mean_path(200))) < 1e-9


def test_combined(planted):
    _, df = planted
    row = outliers.combined_rates(df, ["x"], "k").first()
    assert row["outlier_pct"] == 100 * max(row["outlier_z"], row["outlier_iso"])
    assert outliers.approx_rates(numeric_long(df, ["x"])).agg(F.count("*")).first()[0] == 1


def test_forest_of_two_thousand_columns(spark, monkeypatch):
    """Steps and values are merged: no step table is broadcast, and each planted value is flagged."""
    names = [f"c{i}" for i in range(2000)]
    df = spark.range(0, 40, 1, 2).select(*[F.when(F.col("id") == i % 40, F.lit(1e6)).otherwise((F.col("id") * (i + 1)) % 7).alias(n) for i, n in enumerate(names)])
    long = numeric_long(df, names)
    monkeypatch.setattr(isolation, "TREES", 4)
    monkeypatch.setattr(isolation, "POOL", 4 * isolation.TREE_VALUES)
    rates = isolation.flagged_counts(long)
    got = {r["column_name"]: (r["n"], r["flagged"]) for r in rates.collect()}
    assert set(got) == set(names) and all(n == 40 and 1 <= flagged for n, flagged in got.values())


def test_scores_are_merged_not_broadcast(planted):
    _, df = planted
    long = numeric_long(df, ["x"])
    steps = isolation.forest_steps(long)
    plan = isolation.with_score(long, steps)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "array_sort" not in plan


@pytest.mark.parametrize("rows_per_range", [5, 100_000])
def test_scores_cross_ranges(planted, monkeypatch, rows_per_range):
    from plumbline.operators import ordering

    values, df = planted
    long = numeric_long(df, ["x", "flat"])
    steps = isolation.forest_steps(long).cache()
    monkeypatch.setattr(ordering, "CUT_SAMPLE", 1.0)
    cuts = ordering.numeric_cuts(long, rows_per_range=rows_per_range)
    table = {}
    for r in sorted(steps.collect(), key=lambda r: r["above"]):
        table.setdefault(r["column_name"], []).append((r["above"], r["score"]))
    for r in isolation.with_score(long, steps, cuts).collect():
        assert r["score"] == [s for a, s in table[r["column_name"]] if a < r["value"]][-1]
    steps.unpersist()
