"""Distributed order statistics against numpy, with many forced ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import ordering
from plumbline.operators.ordering import Cuts, exact_quantiles, numeric_cuts, running_totals, text_cuts, with_range

RNG = np.random.default_rng(5)
SAMPLES = {
    "spread": RNG.normal(size=4000) * 1e6,
    "hot": np.where(RNG.random(3000) < 0.4, 7.0, RNG.random(3000) * 100),
    "few": RNG.integers(0, 5, 2000).astype(float),
    "one": np.array([3.5]),
    "same": np.full(500, -2.0),
    "heavy": np.exp(RNG.normal(size=2500) * 6),
}
PROBS = [0.0, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.fixture(scope="module")
def long(spark):
    rows = [(k, float(v)) for k, vs in SAMPLES.items() for v in vs]
    return spark.createDataFrame(rows, "column_name string, value double").repartition(5)


@pytest.fixture(scope="module")
def cuts(spark):
    """31 ranges per column, so that the seams between ranges are exercised."""
    return Cuts(spark, {k: sorted(set(np.quantile(v, np.linspace(0, 1, 33)[1:-1]).tolist())) for k, v in SAMPLES.items()})


def test_quantiles_equal_numpy(long, cuts):
    for given in (cuts, None):
        for r in exact_quantiles(long, ["column_name"], PROBS, given).collect():
            expected = np.quantile(SAMPLES[r["column_name"]], PROBS)
            assert r["n"] == len(SAMPLES[r["column_name"]])
            np.testing.assert_allclose(r["quantiles"], expected, rtol=1e-12)


def test_quantiles_of_counted_values(long, cuts):
    counted = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    for r in exact_quantiles(counted, ["column_name"], PROBS, cuts, weight="n").collect():
        np.testing.assert_allclose(r["quantiles"], np.quantile(SAMPLES[r["column_name"]], PROBS), rtol=1e-12)


def test_quantiles_by_a_second_key(spark, cuts):
    rows = [(k, i % 3, float(v)) for k, vs in SAMPLES.items() for i, v in enumerate(vs)]
    long = spark.createDataFrame(rows, "column_name string, g int, value double")
    for r in exact_quantiles(long, ["column_name", "g"], PROBS, cuts, few_keys=False).collect():
        expected = np.quantile(SAMPLES[r["column_name"]][r["g"] :: 3], PROBS)
        np.testing.assert_allclose(r["quantiles"], expected, rtol=1e-12)


def test_range_is_number_of_cuts_below(long, cuts):
    for r in with_range(long, cuts).sample(0.05, seed=1).collect():
        assert r["range_id"] == np.searchsorted(cuts.points[r["column_name"]], r["value"], side="left")


def test_running_totals(long, cuts):
    counted = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    rows = running_totals(counted, ["column_name"], ["n"], cuts).collect()
    assert len(rows) == sum(len(np.unique(v)) for v in SAMPLES.values())
    for r in rows:
        assert r["cum_n"] == (SAMPLES[r["column_name"]] <= r["value"]).sum()


def test_no_cuts_is_one_range(spark, long):
    counted = long.filter("column_name = 'few'").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    rows = running_totals(counted, ["column_name"], ["n"], Cuts(spark, {"few": []})).collect()
    assert {r["cum_n"] for r in rows} == {int((SAMPLES["few"] <= v).sum()) for v in range(5)}


def test_cuts_are_bounded_and_sorted(long):
    made = numeric_cuts(long, rows_per_range=10)
    assert all(p == sorted(set(p)) and len(p) < 4096 for p in made.points.values())


def test_text_order(spark):
    words = sorted({f"w{i % 700:04d}" for i in range(5000)} | {"", "é", "Z"})
    df = spark.createDataFrame([(w,) for w in words * 2], "value string")
    counted = df.groupBy("value").agg(F.lit(1).cast("bigint").alias("n")).withColumn("all", F.lit(0))
    made = text_cuts(df, "value")
    assert len(made.points[""]) > 10
    ranked = running_totals(counted, ["all"], ["n"], made).collect()
    assert {r["value"]: r["cum_n"] for r in ranked} == {
        w: i + 1 for i, w in enumerate(sorted(words, key=lambda s: s.encode()))
    }


def test_hot_value_is_one_row_per_window(long, cuts):
    """The plan sorts counted values inside (key, range) groups only."""
    counted = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    plan = running_totals(counted, ["column_name"], ["n"], cuts)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_crowded_ranges_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(ordering, "CUT_SAMPLE", 1.0)
    monkeypatch.setattr(ordering, "COARSE_RANGES", 8)
    monkeypatch.setattr(ordering, "MAX_RANGES", 16)
    values = {"wide": np.exp(RNG.normal(size=6000) * 4), "small": RNG.random(300), "hot": np.r_[np.full(3000, 5.0), RNG.random(3000)]}
    long = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "column_name string, value double").repartition(3)
    made = numeric_cuts(long, rows_per_range=50)
    assert made.fine and all(k != "small" for k, _ in made.fine) and all(len(p) <= 16 for p in made.points.values())
    counted = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    largest = with_range(counted, made).groupBy("column_name", "range_id").count().agg(F.max("count")).first()[0]
    assert largest <= 4 * 50  # against 375 with one level
    for joined in (ordering.BROADCAST_POINTS, 0):
        monkeypatch.setattr(ordering, "BROADCAST_POINTS", joined)
        for r in running_totals(counted, ["column_name"], ["n"], made).collect():
            assert r["cum_n"] == (values[r["column_name"]] <= r["value"]).sum()
        for r in exact_quantiles(long, ["column_name"], PROBS, made).collect():
            np.testing.assert_allclose(r["quantiles"], np.quantile(values[r["column_name"]], PROBS), rtol=1e-12)


def test_texts_with_a_long_common_beginning(spark):
    begin = "lorem ipsum " * 170  # 2,040 characters
    texts = [begin + f"{i * 7919 % 100003:06d}" + "x" * (10_000 - len(begin) - 6) for i in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "value string").repartition(4)
    made = text_cuts(df, "value")
    sizes = [r["count"] for r in with_range(df, made).groupBy("range_id").count().collect()]
    assert len(sizes) >= 32 and max(sizes) <= 4 * 1500 / len(sizes)
    counted = df.groupBy("value").agg(F.lit(1).cast("bigint").alias("n")).withColumn("all", F.lit(0))
    ranked = running_totals(counted, ["all"], ["n"], made).select(F.substring("value", len(begin) + 1, 6).alias("k"), "cum_n")
    assert [r["cum_n"] for r in sorted(ranked.collect())] == list(range(1, 1501))
