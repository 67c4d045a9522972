"""The correctness gate: every registered query against its DuckDB oracle."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from oracle_check import compare, duck  # noqa: E402
from retentia.plans.catalog import QUERIES, oracles  # noqa: E402
from conftest import SF_ORACLE  # noqa: E402

SQL = oracles()


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF_ORACLE).toPandas()
    want = con.execute(SQL[name]).df()
    ok, why = compare(got, want)
    assert ok, why


def test_entry_contract(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    own = {n for n in e.queries() if not n.startswith("op") and n != "pipeline"}
    assert own - set(e.oracle_sql()) == {"score_accounts", "cv_trials"}


# Queries whose plans change shape with the data size. At sf0.01 they take
# the small-data paths; these parameters force the paths a large table takes
# (many value buckets per group in a deep tree of cuts, a coarse quantile sketch with wide brackets,
# many rounds and buckets of the split) and the results must not change.
SCALE_PATH_QUERIES = ["roc_auc", "average_precision", "quality_by_side", "drift_psi", "drift_ks", "drift_wasserstein",
                      "drift_summary", "feature_medians", "scenario_features", "stratified_split", "cv_folds", "top_factors"]


@pytest.mark.parametrize("name", SCALE_PATH_QUERIES)
def test_large_data_paths_match_oracle(spark, con, monkeypatch, name):
    import retentia.operators.prefix as P
    import retentia.operators.quantiles as Q
    import retentia.operators.split as S

    monkeypatch.setattr(P, "BUCKET_ROWS", 40)
    monkeypatch.setattr(P, "FAN_OUT", 8)  # two levels of cuts
    monkeypatch.setattr(P, "BROADCAST_CUTS", 4)
    monkeypatch.setattr(Q, "SKETCH_ACCURACY", 200)
    monkeypatch.setattr(S, "BUCKET_ROWS", 3)
    monkeypatch.setattr(S, "DIGITS", 2)
    got = QUERIES[name](spark, SF_ORACLE).toPandas()
    ok, why = compare(got, con.execute(SQL[name]).df())
    assert ok, why


def test_model_checks_match_oracle(spark, con):
    from retentia.plans.training import MODEL_QUERIES

    for name in ("score_accounts_check", "explained_accounts_check", "cv_trials_check", "fixed_model_scores"):
        ok, why = compare(MODEL_QUERIES[name](spark, SF_ORACLE).toPandas(), con.execute(SQL[name]).df())
        assert ok, (name, why)


def test_shifted_sides_drift(spark):
    drifted = {r["column"] for r in QUERIES["drift_shifted"](spark, SF_ORACLE).collect() if r["drifted"]}
    assert "plan_value_index" in drifted and "monthly_usage_hours" not in drifted
