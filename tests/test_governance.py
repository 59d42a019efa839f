"""Rules and checks on literal tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators import checks, rules
from plumbline.operators.checks import Rule

PROFILE = "column_name string, kind string, is_id boolean, is_datetime boolean, missing_pct double, duplicate_pct double, outlier_iso_pct double, dq_score double, referential_integrity double"


def profiled(spark, *rows):
    return spark.createDataFrame(list(rows), PROFILE)


def types(df):
    return {(r["column_name"], r["rule_type"], r["severity"], r["confidence"]) for r in df.collect()}


def test_heuristic_catalogue(spark):
    df = profiled(
        spark,
        ("user_id", "numeric", True, False, 50.0, 0.0, 9.0, 100.0, 0.5),
        ("created", "datetime", False, True, 25.0, 0.0, 0.0, 70.0, None),
        ("kind", "text", False, False, 0.0, 90.0, 0.0, 80.0, 0.9),
        ("age", "numeric", False, False, 12.0, 0.0, 5.1, 59.0, 0.96),
        ("CustomerAge", "numeric", False, False, 0.0, 0.0, 5.0, 80.0, 1.0),
        ("mileage", "numeric", False, False, 0.0, 0.0, 0.0, 80.0, None),
        ("tax_rate", "numeric", False, False, 0.0, 0.0, 0.0, 80.0, None),
        ("corporate", "numeric", False, False, 0.0, 0.0, 0.0, 80.0, None),
        ("unitprice", "numeric", False, False, 0.0, 0.0, 0.0, 80.0, None),
    )
    assert types(rules.rules_heuristic(df)) == {
        ("user_id", "primary_key", "High", "High"),
        ("user_id", "stability", "Medium", "Medium"),
        ("created", "datetime_validity", "High", "High"),
        ("created", "staleness", "High", "Medium"),
        ("kind", "domain_constraint", "Medium", "High"),
        ("kind", "text_standardization", "Medium", "Medium"),
        ("kind", "referential_integrity", "High", "High"),
        ("age", "business_range", "High", "High"),
        ("age", "outlier_monitor", "High", "Medium"),
        ("age", "missing_values", "High", "High"),
        ("age", "referential_integrity", "Medium", "High"),
        ("CustomerAge", "business_range", "High", "High"),
        ("tax_rate", "percentage_range", "Medium", "High"),
        ("unitprice", "non_negative", "Medium", "High"),
    }
    wide = types(rules.rules_heuristic(df, compat=True))
    assert ("mileage", "business_range", "High", "High") in wide and ("corporate", "percentage_range", "Medium", "High") in wide


def test_enforcement_sql_runs(spark):
    spark.range(5).selectExpr("id AS unitprice", "current_timestamp() AS created", "'x' AS kind").createOrReplaceTempView("goods")
    df = profiled(
        spark,
        ("unitprice", "numeric", False, False, 20.0, 0.0, 9.0, 59.0, 0.5),
        ("created", "datetime", False, True, 25.0, 0.0, 0.0, 70.0, None),
        ("kind", "text", True, False, 0.0, 90.0, 0.0, 80.0, 0.9),
        ("kind", "text", False, False, 0.0, 90.0, 0.0, 80.0, 0.9),
    )
    for r in rules.rules_heuristic(df).collect():
        sql = r["enforcement_sql"].replace("<TABLE>", "goods").replace("<REF_TABLE>", "goods").replace("<REF_COL>", r["column_name"])
        spark.sql(sql).collect()


def test_rules_basic(spark):
    schema = "column_name string, type string, kind string, is_id boolean, null_pct double, unique_count bigint, outlier_pct double, min double, max double, freshness_days bigint"
    df = spark.createDataFrame(
        [
            ("k", "bigint", "numeric", True, 0.0, 9, 0.0, 1.0, 9.0, None),
            ("x", "double", "numeric", False, 1.0, 9, 6.0, 1.5, 9.25, None),
            ("s", "string", "text", False, 1.0, 1001, 0.0, None, None, None),
            ("d", "date", "datetime", False, 0.0, 9, 0.0, None, None, 400),
        ],
        schema,
    )
    got = {r["column_name"]: r["rules"] for r in rules.rules_basic(df).collect()}
    assert [len(got[c]) for c in "kxsd"] == [3, 3, 4, 2]
    assert got["x"][0] == "Enforce numeric range: [1.50, 9.25]."


def test_dataset_rules(spark):
    def text(score):
        return rules.dataset_rules(spark.createDataFrame([(score,)], "dataset_score double")).first()["rule"]

    assert "remediation" in text(59.9) and "monitoring and targeted" in text(60.0) and "continue" in text(75.0)
    empty = spark.createDataFrame([(None,)], "dataset_score double")
    assert rules.dataset_rules(empty).count() == 0
    pairs = spark.createDataFrame([("a", "b", 0.987)], "col_a string, col_b string, corr double")
    notes = [r[0] for r in rules.dataset_rules_v1(spark.createDataFrame([(79.0,)], "dataset_score double"), pairs).collect()]
    assert len(notes) == 2 and "a ~ b (corr=0.99)" in notes[1]


SUGGESTED = "column_name string, rule string, rule_type string, severity string, confidence string, enforcement_sql string, rationale string"


def test_enrich_union_dedup(spark):
    bounds = spark.createDataFrame([("x", 3.2, 100.0), ("s", None, None)], "column_name string, min double, max double")
    suggested = spark.createDataFrame(
        [
            ("x", "x must be at least 3.2", "validation", "High", "High", "x < 3.2", "seen"),
            ("x", "x below 99", "validation", None, None, None, None),
            ("s", "s has 3.2 parts", "validation", "Low", "Medium", "", "r"),
            ("gone", "any", "validation", "Low", "High", "", None),
        ],
        SUGGESTED,
    )
    got = {(r["column_name"], r["rule"]): r for r in rules.rules_enrich(suggested, bounds).collect()}
    hit = got["x", "x must be at least 3.2"]
    assert hit["confidence"] == "Low" and hit["source"] == "llm-data-derived" and "data-derived" in hit["rationale"]
    assert got["x", "x below 99"]["source"] == "llm" and got["s", "s has 3.2 parts"]["confidence"] == "Medium"
    assert got["gone", "any"]["confidence"] == "Low" and "not found" in got["gone", "any"]["rationale"]

    made = spark.createDataFrame(
        [("x", "X must be AT LEAST 3.2!", "range", "High", "Low", "q", "w", "heuristic", 0), ("x", "other", "range", "High", "High", "q", "w", "heuristic", 1)],
        SUGGESTED + ", source string, place int",
    )
    union = rules.rules_union(made, rules.rules_enrich(suggested, bounds))
    assert union.count() == 6
    assert union.filter("rule = 'x below 99'").first()["severity"] == "Medium"
    best = {r["rule"]: r["source"] for r in rules.rules_dedup(union).collect()}
    # equal confidence: the heuristic source wins
    assert best["X must be AT LEAST 3.2!"] == "heuristic" and "x must be at least 3.2" not in best and len(best) == 5


def test_empty_rule_tables(spark):
    none = profiled(spark)
    assert rules.rules_heuristic(none).count() == 0
    empty = spark.createDataFrame([], SUGGESTED)
    full = none.withColumns({"min": F.lit(None).cast("double"), "max": F.lit(None).cast("double")})
    table = rules.governance_table(full, empty)
    assert table.count() == 0 and table.columns[-1] == "source"


@pytest.mark.parametrize(
    ("severity", "confidence", "score", "risk"),
    [("High", "High", 0.0, 100.0), ("High", "Low", 50.0, 20.0), ("odd", "odd", None, 12.5), ("Low", "Medium", 100.0, 0.0), ("Medium", "High", 150.0, 0.0)],
)
def test_risk_index(spark, severity, confidence, score, risk):
    df = spark.createDataFrame([(severity, confidence, score)], "s string, c string, q double")
    assert df.select(rules.risk_index(F.col("s"), F.col("c"), F.col("q"))).first()[0] == risk


def test_labels_and_pseudo_logic(spark):
    df = spark.createDataFrame([("heuristic",), ("llm",), ("llm-data-derived",), ("by hand",), (None,)], "s string")
    assert [r[0] for r in df.select(rules.source_label(F.col("s"))).collect()] == [
        "Rule Engine", "AI-Inferred", "AI-Inferred (Low Confidence)", "By Hand", "",
    ]
    one = spark.createDataFrame([("business_range", "age"), ("strange", "x")], "t string, c string")
    assert [r[0] for r in one.select(rules.pseudo_logic(F.col("t"), F.col("c"))).collect()] == [
        "if age < 0 or age > 120 -> flag record", "if x violates rule -> flag record",
    ]


@pytest.fixture(scope="module")
def goods(spark):
    rows = [(1, "a", 5.0, dt.datetime(2024, 1, 1), "2024-01-01"), (2, "b", -1.0, dt.datetime(2023, 1, 1), "x"),
            (2, None, None, None, None), (None, "Z9", float("nan"), dt.datetime(2024, 3, 1), "2024/02/02")]
    return spark.createDataFrame(rows, "k bigint, s string, x double, ts timestamp_ntz, day string")


def test_checks(spark, goods):
    assert checks.check_not_null(goods, "x").count() == 2  # NaN is missing
    assert {r[0]: r[1] for r in checks.check_missing_count(goods, ["k", "x"]).collect()} == {"k": 1, "x": 2}
    assert [(r["value"], r["n"]) for r in checks.check_unique(goods, "k").collect()] == [(2, 2)]
    assert checks.check_range(goods.filter("NOT isnan(x)"), "x", 0, 4).count() == 2
    assert checks.check_range(goods, "x", low=0).count() == 1
    assert checks.check_regex(goods, "s", "^[a-z]$").count() == 1
    ref = spark.createDataFrame([(1,), (None,)], "id bigint")
    assert [r["k"] for r in checks.check_fk(goods, "k", ref, "id").collect()] == [2, 2]
    assert checks.check_staleness(goods, "ts", "2024-03-02 00:00:00").count() == 1
    assert checks.check_datetime_parse(goods, "day").count() == 2
    assert [(r["value"], r["n"]) for r in checks.check_taxonomy(goods, "s", spark.createDataFrame([("a",), ("b",)], "c string"), "c").collect()] == [("Z9", 1)]
    assert checks.check_max_length(goods, "s", 1).count() == 1


def test_scorecard(spark, goods):
    ref = spark.createDataFrame([(1,)], "id bigint")
    made = [Rule("r", "s", "row", "s IS NULL", tolerance=0.25), Rule("u", "k", "unique"), Rule("f", "k", "fk", reference=ref, reference_key="id")]
    got = {r["rule_id"]: (r["checked"], r["violations"], r["passed"]) for r in checks.rule_scorecard(goods, made).collect()}
    assert got == {"r": (4, 1, True), "u": (4, 2, False), "f": (4, 2, False)}
    with pytest.raises(ValueError):
        checks.rule_scorecard(goods, [Rule("x", "k", "other")])


def test_remediation(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), (None, None)], "s string, t string")
    filled = [tuple(r) for r in checks.fill_mode_or_unknown(df, ["s", "t"]).collect()]
    assert filled[-1] == ("a", "Unknown") and filled[0] == ("b", "Unknown")
    assert checks.drop_missing(df, ["s"]).count() == 4
    mixed = spark.createDataFrame([(" A  b",), ("a B",), ("a\tb",), ("c",)], "s string")
    row = checks.canonicalize_text(mixed, ["s"]).first()
    assert (row["distinct_before"], row["distinct_after"]) == (4, 2)


def test_scorecard_scans_do_not_grow_with_the_rules(spark, tmp_path):
    spark.range(3000).selectExpr("id % 900 AS a", "id AS b", "CAST(id % 50 AS STRING) AS c", "CAST(NULL AS INT) AS d", "repeat(CAST(id % 3 AS STRING), 90) AS e").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    small = spark.range(40).selectExpr("CAST(id AS STRING) AS k", "repeat(CAST(id AS STRING), 90) AS l")
    unique = [checks.Rule(f"u{n}", n, "unique") for n in "abcde"]
    known = [checks.Rule(f"f{i}", n, "fk", reference=small.filter(f"CAST(k AS INT) < {40 - i}"), reference_key=k) for i, (n, k) in enumerate([("c", "k"), ("c", "k"), ("a", "k"), ("e", "l"), ("d", "k")])]
    rows = [checks.Rule(f"r{i}", "a", "row", f"a > {i}") for i in range(5)]
    got = {r["rule_id"]: (r["checked"], r["violations"]) for r in checks.rule_scorecard(df, [*rows, *unique, *known]).collect()}
    assert got == {
        **{f"r{i}": (3000, sum(x % 900 > i for x in range(3000))) for i in range(5)},
        "ua": (3000, 3000), "ub": (3000, 0), "uc": (3000, 3000), "ud": (3000, 0), "ue": (3000, 3000),
        "f0": (3000, 600), "f1": (3000, 660), "f2": (3000, sum(x % 900 >= 38 for x in range(3000))), "f3": (3000, 0), "f4": (3000, 0),
    }

    def size(rules):
        plan = checks.rule_scorecard(df, rules)._jdf.queryExecution().executedPlan().toString()
        return plan.count("FileScan parquet"), plan.count("Exchange hashpartitioning")

    assert size([*rows, *unique])[0] == size([rows[0], unique[0]])[0] == 2
    assert size(unique) == size(unique[:1]) == (1, 1)
    assert size(known)[0] == 1 and size(known)[1] == size(known[:1])[1]


def test_modes_are_counted_once(spark, tmp_path):
    rows = [("b", "x", None), ("b", None, None), ("a", "y", None), ("a", "y", None), (None, None, None)]
    spark.createDataFrame(rows, "p string, q string, r string").write.parquet(f"{tmp_path}/m")
    df = spark.read.parquet(f"{tmp_path}/m")
    filled = checks.fill_mode_or_unknown(df, ["p", "q", "r"])
    assert sorted(tuple(r) for r in filled.collect()) == [("a", "y", "Unknown")] * 3 + [("b", "x", "Unknown"), ("b", "y", "Unknown")]
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("FileScan parquet") <= 2 + plan.split("== Initial Plan ==")[0].count("ReusedSubquery")
    assert tuple(checks.mode_values(df, ["p", "q", "r"]).first()) == ("a", "y", None)
