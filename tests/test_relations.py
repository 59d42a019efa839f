import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import contingency
from plumbline.functions.comoments import CoMoments
from plumbline.operators import relations as rel

RNG = np.random.default_rng(2)


def frame(spark):
    n = 1200
    a = RNG.integers(0, 4, n)
    b = np.where(RNG.random(n) < 0.8, a % 2, RNG.integers(0, 3, n))
    rows = [(None if i % 50 == 0 else f"a{a[i]}", f"b{b[i]}", float(a[i]), float(a[i] * 2 + 1), 1.0) for i in range(n)]
    return rows, spark.createDataFrame(rows, "a string, b string, x double, y double, one double")


def test_cramers_v_and_mode_share(spark):
    rows, df = frame(spark)
    pairs = [("a", "b"), ("b", "a")]
    table = {}
    for r in rows:
        key = (r[0] or "__NA__", r[1])
        table[key] = table.get(key, 0) + 1
    xs, ys = sorted({k[0] for k in table}), sorted({k[1] for k in table})
    o = np.array([[table.get((x, y), 0) for y in ys] for x in xs], float)
    n, e = o.sum(), o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    r, k = o.shape
    phi2 = max(0, ((o - e) ** 2 / e).sum() / n - (k - 1) * (r - 1) / (n - 1))
    expected = math.sqrt(phi2 / min(k - (k - 1) ** 2 / (n - 1) - 1, r - (r - 1) ** 2 / (n - 1) - 1))
    got = {(q["col1"], q["col2"]): q["cramers_v"] for q in rel.cramers_v(df, pairs).collect()}
    assert math.isclose(got["a", "b"], expected, rel_tol=1e-9) and math.isclose(got["b", "a"], expected, rel_tol=1e-9)
    known = o[[i for i, x in enumerate(xs) if x != "__NA__"]]
    share = rel.conditional_mode_share(df, [("a", "b")]).first()["mode_share"]
    assert math.isclose(share, (known.max(1) / known.sum(1)).mean(), rel_tol=1e-12)
    signals = rel.statistical_signals(df, {"b": ["a"]}).first()
    assert math.isclose(signals["max_cramers_v"], expected) and math.isclose(signals["avg_mode_share"], share)


def test_one_level_has_no_association(spark):
    df = spark.createDataFrame([("x", "p"), ("x", "q")], "a string, b string")
    assert rel.cramers_v(df, [("a", "b")]).first()["cramers_v"] == 0


def test_fd_both_directions(spark):
    df = spark.createDataFrame([("1", "a"), ("1", "a"), ("1", "b"), ("2", "c"), (None, "d"), ("3", None)], "k string, v string")
    row = rel.fd_consistency(df, [("k", "v")]).collect()
    assert [(r["key"], r["n_distinct"], r["rows"]) for r in row] == [("1", 2, 3)]
    assert rel.fd_consistency(df, [("k", "v")], min_mode_share=0.5).count() == 0
    report = {(r["col1"], r["col2"]): r["inconsistent_keys"] for r in rel.cross_relation_report(df, [("k", "v")]).collect()}
    assert report == {("k", "v"): 1}


def test_correlation(spark):
    _, df = frame(spark)
    pairs = {(r["col_a"], r["col_b"]): r["corr"] for r in rel.corr_matrix(df).collect()}
    assert math.isclose(pairs["x", "y"], 1.0) and pairs["x", "one"] is None and len(pairs) == 3
    assert [(r["col_a"], r["col_b"]) for r in rel.high_corr_pairs(df).collect()] == [("x", "y")]
    assert rel.full_corr_matrix(df, ["x", "y"]).count() == 4
    assert rel.corr_matrix(df.select("x")).count() == 0


def test_candidates_and_context(spark):
    df = spark.range(300).selectExpr(
        "id AS user_id", "concat('n', id) AS title", "CAST(id % 3 AS STRING) AS colour", "concat('text ', id) AS note"
    )
    assert [(r[0], r[1]) for r in rel.candidate_pairs(df.withColumn("b", df.user_id % 2)).collect()] == [("colour", "b")]
    assert {r["column_name"] for r in rel.select_candidates(df, include_numeric=False).collect()} == {"user_id", "colour"}
    ranked = [(r["column_name"], r["score"]) for r in rel.rank_context_columns(df, "colour").collect()]
    assert ranked == [("title", 2.5), ("note", 1.5), ("user_id", 0.5)]


def pair_by_pair(values):
    """Pearson over the complete rows of every pair, two passes."""
    out = {}
    for i in range(values.shape[1]):
        for j in range(i + 1, values.shape[1]):
            both = values[~np.isnan(values[:, i]) & ~np.isnan(values[:, j])][:, [i, j]]
            x, y = (both - both.mean(axis=0)).T if len(both) else (np.zeros(0), np.zeros(0))
            constant = not len(both) or (both == both[0]).all(axis=0).any()
            out[i, j] = None if constant else float((x * y).sum() / np.sqrt((x**2).sum()) / np.sqrt((y**2).sum()))
    return out


def test_correlation_of_a_hundred_columns(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(700, 100))
    base[:, 1:50] += base[:, :1]
    base[:, 3] = 1e9 + 1e-3 * base[:, 2]  # small spread far from 0
    base[:, 5] = 7.25
    base[rng.random(base.shape) < 0.2] = np.nan
    base[:, 6] = np.nan
    base[:, 7] = np.where(np.arange(700) < 3, 1.0, np.nan)
    base[:, 8] = np.where(np.isnan(base[:, 9]), rng.normal(size=700), 0.1)  # constant where the next one is present
    df = spark.createDataFrame(pd.DataFrame(base, columns=[f"c{i}" for i in range(100)])).repartition(7)
    got = {(int(r["col_a"][1:]), int(r["col_b"][1:])): r["corr"] for r in rel.corr_matrix(df).collect()}
    want = pair_by_pair(base)
    assert set(got) == set(want) and len(got) == 4950
    for pair, value in want.items():
        assert (got[pair] is None) == (value is None), pair
        assert value is None or math.isclose(got[pair], value, abs_tol=1e-6 if 3 in pair else 1e-9), pair


def test_correlation_of_infinite_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.5, float("inf")), (4.0, 7.0, 3.0), (5.0, 1.0, None)], "a double, b double, c double")
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in rel.corr_matrix(df).collect()}
    assert math.isnan(got["a", "c"]) and math.isnan(got["b", "c"]) and math.isclose(got["a", "b"], np.corrcoef([1, 2, 4, 5], [2, 4.5, 7, 1])[0, 1])
    assert {r["corr"] for r in rel.corr_matrix(df.limit(0)).collect()} == {None}


def test_correlation_buffers_merge_in_any_order():
    rng = np.random.default_rng(9)
    values = rng.normal(size=(300, 4)) + 50
    values[rng.random(values.shape) < 0.3] = np.nan
    whole, parts = CoMoments(4), [CoMoments(4) for _ in range(3)]
    whole.add(values)
    for part, own in zip(parts, np.array_split(values, 3)):
        part.add(own)
    merged = CoMoments(4)
    for part in reversed(parts):
        merged.merge(part.start, part.n, part.mean, part.squares, part.products)
    assert np.allclose(merged.products, whole.products) and np.allclose(merged.squares, whole.squares) and (merged.n == whole.n).all()


def plain_pairs(rows, i, j, missing):
    counted = {}
    for r in rows:
        a, b = (missing if r[k] is None else r[k] for k in (i, j))
        if a is not None and b is not None:
            counted[a, b] = counted.get((a, b), 0) + 1
    return counted


@pytest.mark.parametrize("missing", [None, "__NA__"])
def test_pair_counts_by_codes(spark, monkeypatch, missing):
    monkeypatch.setattr(contingency, "ROWS", 100)
    monkeypatch.setattr(contingency, "OUT", 50)
    rng = np.random.default_rng(3)
    rows = [(str(rng.integers(5)) if rng.random() < 0.8 else None, f"k{rng.integers(400)}", "same", None) for _ in range(1000)]
    df = spark.createDataFrame(rows, "a string, `b.x` string, c string, d string").repartition(3)
    pairs = [("a", "b.x"), ("b.x", "a"), ("c", "a"), ("a", "c"), ("d", "a"), ("c", "c")]
    got = {}
    for r in rel.pair_counts(df, pairs, missing).collect():
        got.setdefault((r["col1"], r["col2"]), {})[r["v1"], r["v2"]] = r["n"]
    place = {"a": 0, "b.x": 1, "c": 2, "d": 3}
    assert got == {p: c for p in pairs if (c := plain_pairs(rows, place[p[0]], place[p[1]], missing))}


def test_a_hundred_columns_of_fifty_levels(spark):
    names = [f"c{i}" for i in range(100)]
    df = spark.range(0, 40_000, 1, 4).select(*[F.format_string("v%d", (F.col("id") * (2 * i + 1)) % 50).alias(n) for i, n in enumerate(names)])
    df = df.withColumn("c99", F.when(F.monotonically_increasing_id() == 7, F.lit("v999")).otherwise(F.col("c99")))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    report = {(r["col1"], r["col2"]): r for r in rel.cross_relation_report(df, pairs).collect()}
    # the one planted cell breaks its key towards c99, whose own keys it does not touch
    assert report["c0", "c99"]["inconsistent_keys"] == 1 and report["c0", "c99"]["max_distinct"] == 2
    assert ("c0", "c1") not in report and ("c1", "c0") not in report
    plan = rel.pair_counts(df, pairs)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1


def test_candidates_carry_all_distinct_values(spark):
    df = spark.range(0, 900, 1, 4).selectExpr("id AS n", "CAST(id % 800 AS STRING) AS status", "CAST(id % 51 AS STRING) AS s", "CAST(id % 50 AS STRING) AS t", "repeat(CAST(id % 700 AS STRING), 90) AS type_text", "CAST(NULL AS STRING) AS nothing")
    got = {r["column_name"]: (r["by_name"], r["n_unique"]) for r in rel.select_candidates(df).collect()}
    assert got == {"n": (False, 900), "status": (True, 800), "t": (False, 50), "type_text": (True, 700), "nothing": (False, 0)}
