"""Drift measures against numpy, with hot values and many ranges."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import plumbline.operators.ordering as ordering
from plumbline.functions.fit_tests import _chi2_tail
from plumbline.operators import drift

EPS = 1e-8


def plain_deciles(values):
    """Linear interpolation without numpy's rounding, which at times moves an edge off the value that it falls on."""
    x, last = np.sort(values), len(values) - 1
    at = [i / 10 * last for i in range(11)]
    return np.unique([x[math.floor(p)] + (x[math.ceil(p)] - x[math.floor(p)]) * (p - math.floor(p)) for p in at])


def psi(expected, actual, bins=10, edges=None):
    edges = np.unique(np.quantile(expected, np.linspace(0, 1, bins + 1))) if edges is None else edges
    if len(edges) <= 2:
        edges = np.linspace(expected.min(), expected.max(), bins + 1)
    e, _ = np.histogram(expected, bins=edges)
    a, _ = np.histogram(actual, bins=edges)
    e, a = e / (e.sum() + EPS), a / (a.sum() + EPS)
    e, a = np.where(e == 0, EPS, e), np.where(a == 0, EPS, a)
    return float(np.sum((e - a) * np.log(e / a)))


def ks(a, b):
    grid = np.unique(np.concatenate([a, b]))
    return max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)


@pytest.fixture(autouse=True)
def many_ranges(monkeypatch):
    """Small inputs are cut into as many ranges as large ones would be."""
    monkeypatch.setattr(ordering, "CUT_SAMPLE", 1.0)
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 100)


RNG = np.random.default_rng(3)
N = 3000
SIDE = RNG.random(N) < 0.45
DATA = {
    "smooth": RNG.normal(size=N) + np.where(SIDE, 0, 0.3),
    "hot": np.where(RNG.random(N) < 0.4, 5.0, RNG.random(N) * 10),
    "few": RNG.integers(0, 4, N).astype(float),
    "flat": np.full(N, 2.0),
}


@pytest.fixture(scope="module")
def sided(spark):
    rows = [(*[float(DATA[c][i]) for c in DATA], "abc"[i % 3] if SIDE[i] else "abd"[i % 3], bool(SIDE[i])) for i in range(N)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in DATA) + ", cat string, b boolean")
    return drift.split_by_filter(df, "b").drop("b")


def by_column(df):
    return {r["column_name"]: r.asDict() for r in df.collect()}


def test_numeric_measures(sided):
    both = by_column(drift.drift_population(sided, [*DATA, "cat"]))
    alone = by_column(drift.psi_numeric(sided, list(DATA)))
    opened = by_column(drift.psi_numeric(sided, list(DATA), open_ends=True))
    stats = by_column(drift.ks_two_sample(sided, list(DATA)))
    for name, values in DATA.items():
        b, t = values[SIDE], values[~SIDE]
        assert math.isclose(both[name]["ks_stat"], ks(b, t), abs_tol=1e-12)
        assert math.isclose(stats[name]["ks_stat"], ks(b, t), abs_tol=1e-12)
        assert math.isclose(both[name]["psi"], psi(b, t), abs_tol=1e-9)
        assert math.isclose(alone[name]["psi"], psi(b, t), abs_tol=1e-9)
        outside = ((t < b.min()) | (t > b.max())).mean() * 100
        assert math.isclose(alone[name]["out_of_range_pct"], outside, abs_tol=1e-9)
        assert opened[name]["out_of_range_pct"] == 0
        assert both[name]["baseline_n"] == SIDE.sum() and both[name]["target_n"] == N - SIDE.sum()


def test_categorical_measures(sided):
    row = by_column(drift.drift_population(sided, ["cat"]))["cat"]
    cats = np.array(["abc"[i % 3] if SIDE[i] else "abd"[i % 3] for i in range(N)])
    o = np.array([[((cats == c) & SIDE).sum(), ((cats == c) & ~SIDE).sum()] for c in "abcd"], float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    assert math.isclose(row["chi2"], ((o - e) ** 2 / e).sum(), rel_tol=1e-9)
    assert row["dof"] == 3 and 0 <= row["chi2_p"] < 1e-6
    p = o / o.sum(0)
    p = np.where(p == 0, EPS, p)
    assert math.isclose(row["psi"], ((p[:, 0] - p[:, 1]) * np.log(p[:, 0] / p[:, 1])).sum(), rel_tol=1e-6)
    # the compatibility measure bins the shares themselves
    shares = o / o.sum(0)
    got = by_column(drift.psi_share_hist(sided, ["cat"]))["cat"]["psi_share_hist"]
    assert math.isclose(got, psi(shares[:, 0], shares[:, 1], bins=4), rel_tol=1e-6)


@pytest.mark.parametrize("counts", [[(5, 5), (5, 5)], [(1, 9), (2, 8), (2, 1), (4, 4), (4, 0), (0, 3)], [(7, 3)], [(3, 1), (3, 2), (3, 3)], [(10, 1), (0, 5)]])
def test_share_histogram_shapes(spark, counts):
    rows = [(f"v{i}", side) for i, (b, t) in enumerate(counts) for side in [True] * b + [False] * t]
    df = spark.createDataFrame(rows, "c string, b boolean")
    got = by_column(drift.psi_share_hist(drift.split_by_filter(df, "b"), ["c"]))["c"]["psi_share_hist"]
    o = np.array(counts, float)
    s = o / o.sum(0)
    assert math.isclose(got, psi(s[:, 0], s[:, 1], bins=len(o) if len(o) > 1 else 2), rel_tol=1e-6, abs_tol=1e-9)


def test_prefer_type(sided):
    assert by_column(drift.drift_population(sided, ["few"], prefer_type="categorical"))["few"]["type"] == "categorical"
    with pytest.raises(ValueError):
        drift.drift_population(sided, ["few"], prefer_type="vague")


def test_empty_side_has_no_index(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, c string")
    got = by_column(drift.drift_population(drift.split_by_filter(df, "x > 100"), ["x", "c"]))
    assert got["x"]["psi"] is None and got["x"]["ks_stat"] is None
    assert got["c"]["psi"] is None and got["c"]["chi2"] is None


def test_filters_raise(spark):
    df = spark.range(3)
    for bad in ("", "id > 1; drop", "nothing_here > 1"):
        with pytest.raises(Exception):
            drift.apply_filter(df, bad).collect()
    assert drift.apply_filter(df, "id > 0").count() == 2


def test_split_by_time_ties_and_missing(spark):
    start = dt.datetime(2024, 1, 1)
    # a third of the rows share one time; some have none
    rows = [(i, None if i % 10 == 0 else start + dt.timedelta(days=5 if i % 3 == 0 else i)) for i in range(200)]
    df = spark.createDataFrame(rows, "k bigint, ts timestamp_ntz")
    expected = sorted(rows, key=lambda r: (r[1] is None, r[1] or start, r[0]))
    for fraction in (0.02, 0.2, 0.7, 0.95, 1.0):
        n = max(1, int(len(rows) * fraction))
        got = {r["k"] for r in drift.split_by_time(df, "ts", "k", fraction).filter("in_base").collect()}
        assert got == {k for k, _ in expected[:n]}


def test_split_random_is_stable(spark):
    df = spark.range(10_000)
    split = drift.split_random(df, "id", seed=4)
    base = split.filter("in_base").count()
    assert abs(base - 7000) < 200
    assert base == drift.split_random(df.repartition(7), "id", seed=4).filter("in_base").count()
    assert split.filter("in_base = in_target").count() == 0


def test_temporal(spark):
    start = dt.datetime(2023, 1, 5)
    rows, per = [], {}
    for i in range(2400):
        month = [0, 1, 1, 2, 4, 5][i % 6]  # the fourth month has no rows
        value = None if month == 2 else float(RNG.normal() + month * (i % 6 == 3))
        rows.append((start + dt.timedelta(days=30 * month), value, "xy"[int(RNG.random() < 0.3)]))
        per.setdefault(rows[-1][0].strftime("%Y-%m"), []).append(rows[-1])
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double, c string")
    series = {(r["column_name"], r["period"]): r["psi"] for r in drift.psi_series(df, "ts", ["v", "c"]).collect()}
    months = sorted(per)
    assert set(series) == {(c, m) for c in ("v", "c") for m in months[1:]}
    for a, b in zip(months, months[1:]):
        x, y = [np.array([r[1] for r in per[m] if r[1] is not None]) for m in (a, b)]
        if len(x) and len(y):
            assert math.isclose(series["v", b], psi(x, y), abs_tol=1e-9)
        else:
            assert series["v", b] is None
    summary = by_column(drift.drift_temporal(df, "ts", ["v", "c"]))
    known = [series["v", m] for m in months[1:] if series["v", m] is not None]
    assert math.isclose(summary["v"]["avg_psi"], np.mean(known)) and math.isclose(summary["v"]["max_psi"], max(known))
    assert summary["v"]["periods_analyzed"] == len(months) - 1


def test_one_month_falls_back(spark):
    rows = [(i, dt.datetime(2024, 1, 1 + i % 20), float(i % 50)) for i in range(500)]
    df = spark.createDataFrame(rows, "k bigint, ts timestamp_ntz, v double")
    got = drift.drift_over_time(df, "ts", ["v"], "k").first()
    assert got["type"] == "numeric" and got["baseline_n"] + got["target_n"] == 500


def test_segments(spark):
    groups = np.where(RNG.random(N) < 0.4, "big", np.array([f"g{i % 20:02d}" for i in range(N)]))
    values, cats = DATA["hot"], np.array(["pq"[i % 2] for i in range(N)])
    rows = [(None if groups[i] == "g03" else str(groups[i]), float(values[i]), str(cats[i])) for i in range(N)]
    df = spark.createDataFrame(rows, "g string, v double, c string")
    labels = np.where(groups == "g03", "__NA__", groups)
    names, sizes = np.unique(labels, return_counts=True)
    top = [n for _, n in sorted(zip(-sizes, names))][:12]
    got = {(r["column_name"], r["segment"]): r for r in drift.drift_segment(df, "g", ["v", "c"]).collect()}
    assert set(got) == {(c, g) for c in ("v", "c") for g in names}
    twelve = {(r["column_name"], r["segment"]): r for r in drift.drift_segment(df, "g", ["v", "c"], k=12).collect()}
    assert set(twelve) == {(c, g) for c in ("v", "c") for g in top} and all(math.isclose(twelve[k]["psi"], got[k]["psi"], abs_tol=1e-12) for k in twelve)
    assert all(got["v", g]["baseline_n"] == n for g, n in zip(names, sizes))
    for g in names:
        own, rest = values[labels == g], values[labels != g]
        r = got["v", g]
        assert math.isclose(r["ks_stat"], ks(own, rest), abs_tol=1e-12)
        assert math.isclose(r["psi"], psi(own, rest, edges=plain_deciles(own)), abs_tol=1e-9)
        assert r["baseline_n"] == len(own) and r["target_n"] == len(rest)
        o = np.array([[((cats == c) & (labels == g)).sum(), ((cats == c) & (labels != g)).sum()] for c in "pq"], float)
        e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
        assert math.isclose(got["c", g]["chi2"], ((o - e) ** 2 / e).sum(), rel_tol=1e-9, abs_tol=1e-12)


def test_flags_and_summary(spark):
    rows = [("a", 0.5, None, None), ("b", 0.1, 0.01, None), ("c", None, 0.2, 0.9), ("d", 0.2, 0.05, 0.05)]
    records = spark.createDataFrame(rows, "column_name string, psi double, ks_p double, chi2_p double")
    flagged = drift.with_flags(records)
    assert {r["column_name"]: r["flagged"] for r in flagged.collect()} == {"a": True, "b": True, "c": False, "d": False}
    row = drift.drift_summary(flagged).first()
    assert (row["n_records"], row["n_flagged"], row["flagged_columns"]) == (4, 2, "a, b")


def test_tail_probabilities(spark):
    # published chi-square points: 5 % and 1 %
    for dof, x in [(1, 3.841459), (2, 5.991465), (3, 7.814728), (4, 9.487729), (10, 18.307038), (99, 123.225221)]:
        assert math.isclose(_chi2_tail(x, dof), 0.05, abs_tol=1e-6)
    assert math.isclose(_chi2_tail(6.634897, 1), 0.01, abs_tol=1e-6)
    assert _chi2_tail(0.0, 5) == 1.0 and _chi2_tail(3.0, 0) == 1.0 and _chi2_tail(1e6, 5) == 0.0
    df = spark.createDataFrame([(0.0, 50, 50), (1.0, 500, 500), (0.1923304, 100, 100)], "d double, a int, b int")
    p = [r[0] for r in df.select(drift.ks_p_value(F.col("d"), F.col("a"), F.col("b"))).collect()]
    assert p[0] == 1.0 and p[1] < 1e-12 and 0.03 < p[2] < 0.06


def test_auto_columns(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 3)], "s string, i int, d double, j int")
    assert drift.auto_columns(df) == ["i", "d"]
    assert drift.auto_columns(df.select("s")) == ["s"]


def plain_category(own, rest):
    """chi2, dof and index over all categories of both sides, the absent ones too."""
    names = sorted(set(own) | set(rest))
    o = np.array([[own.count(n), rest.count(n)] for n in names], float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    shares = o / (o.sum(0) + 1e-8)
    shares[o == 0] = 1e-8
    return ((o - e) ** 2 / e).sum(), len(names) - 1, ((shares[:, 0] - shares[:, 1]) * np.log(shares[:, 0] / shares[:, 1])).sum()


def test_absent_categories_in_closed_form(spark):
    rng = np.random.default_rng(11)
    group = rng.integers(0, 9, 900)
    value = np.where(group < 3, rng.zipf(1.6, 900) % 40, rng.integers(20, 70, 900))
    value[group == 8] = 99  # a category of one group alone
    rows = [(None if g == 4 else f"g{g}", None if v == 33 else f"v{v}") for g, v in zip(group, value)] + [("lone", "v1")]
    got = {r["segment"]: r for r in drift.drift_segment(spark.createDataFrame(rows, "g string, c string"), "g", ["c"]).collect()}
    assert set(got) == {g or "__NA__" for g, _ in rows}
    for name, r in got.items():
        own = [v for g, v in rows if v is not None and (g or "__NA__") == name]
        rest = [v for g, v in rows if v is not None and (g or "__NA__") != name]
        chi2, dof, index = plain_category(own, rest)
        assert math.isclose(r["chi2"], chi2, rel_tol=1e-9) and r["dof"] == dof and math.isclose(r["psi"], index, rel_tol=1e-9)
        assert (r["baseline_n"], r["target_n"]) == (len(own), len(rest))


def test_many_groups_and_categories(spark):
    n = 100_000
    df = spark.range(2 * n).select(F.format_string("g%d", F.col("id") % n).alias("g"), F.format_string("c%d", F.col("id") % (n - 1)).alias("c"))
    found = drift.drift_segment(df, "g", ["c"])
    row = found.agg(F.count("*").alias("groups"), F.min("dof").alias("dof"), F.max("baseline_n").alias("most"), F.count_if(F.col("psi").isNull()).alias("gaps")).first()
    assert (row["groups"], row["dof"], row["most"], row["gaps"]) == (n, n - 2, 2, 0)


def test_segments_with_few_distinct_deciles(spark):
    rng = np.random.default_rng(12)
    parts = {"flat": np.r_[np.zeros(400), [1.0, 2.0, 3.0]], "two": np.r_[np.zeros(50), np.ones(50)], "one": np.full(9, 2.5), "wide": rng.normal(1, 2, 300)}
    rows = [(g, float(v)) for g, values in parts.items() for v in values]
    got = {r["segment"]: r for r in drift.drift_segment(spark.createDataFrame(rows, "g string, v double"), "g", ["v"]).collect()}
    for name, own in parts.items():
        sided = drift.split_by_filter(spark.createDataFrame(rows, "g string, v double"), f"g = '{name}'")
        want = drift.drift_population(sided, ["v"]).first()
        assert math.isclose(got[name]["psi"], want["psi"], abs_tol=1e-9) and math.isclose(got[name]["ks_stat"], want["ks_stat"], abs_tol=1e-12)
