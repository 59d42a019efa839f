"""The registered queries beside their SQL.

The quick ones run here on the smallest tables; PLUMBLINE_ALL=1 runs every one,
and tests/compare.py does the same with a report.
"""

import os

import pytest

import __spark_entry__ as contract
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
QUICK = """scan_parquet scan_csv dataset_overview sample_values sql_query sql_set_ops sql_subquery apply_filter
join_membership_rate join_complement crosstab top_missing_columns completeness date_stats range_conformity
monotone_order outlier_zscore outlier_rows fd_consistency cramers_v psi_categorical chi2_two_sample split_by_time
check_unique check_fk rule_scorecard rules_enrich rules_dedup reply_parse_json reasons_dedup ate_stratified
category_codes chart_histogram chart_box chart_drift_shares corr_matrix drift_segment_nations explorative_profile
numeric_verdict verdict_aggregate basic_profile is_low_cardinality candidate_pairs select_candidates
cross_relation_report ate_psm chart_kde outlier_iforest_planted fill_mode_or_unknown""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def test_contract():
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries) and set(QUICK) <= set(queries)
    assert len(queries) > 150 and len(sql) > 140


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 11 and all(0 <= r["dq_score"] <= 100 for r in rows)


@pytest.mark.parametrize("name", sorted(contract.queries()) if os.environ.get("PLUMBLINE_ALL") else QUICK)
def test_same_rows_as_sql(spark, name):
    df = contract.queries()[name](spark, SF)
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert df.collect()
    else:
        assert [p for p in differences(df, connect(SF), sql) if p != "no rows"] == []
