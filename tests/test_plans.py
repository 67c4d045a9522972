"""Plan-shape guards for the properties the scale design relies on."""

import contextlib
import io

from retentia.plans.catalog import QUERIES
from conftest import SF_SMALL

PYTHON_NODES = ("MapInPandas", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "PythonUDF")


def _plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_account_scan_prunes_and_pushes_down(spark):
    plan = _plan(QUERIES["account_scan"](spark, SF_SMALL))
    scans = [block for block in plan.split("\n(") if "Scan parquet" in block.split("\n")[0]]
    orders = [b for b in scans if "orders.parquet" in b]
    lineitem = [b for b in scans if "lineitem.parquet" in b]
    assert len(orders) == 2, "the year's orders, and customers with later ones"
    assert all("GreaterThanOrEqual(o_orderdate" in b for b in orders)
    assert sum("ReadSchema: struct<o_custkey:bigint,o_orderdate" in b for b in orders) == 1
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in lineitem[0]
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_and_metrics_stay_in_the_jvm(spark):
    for name in ("roc_auc", "average_precision", "drift_ks", "drift_psi", "feature_medians", "stratified_split"):
        plan = _plan(QUERIES[name](spark, SF_SMALL))
        assert not any(node in plan for node in PYTHON_NODES), name
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_top_factors_need_no_shuffle_per_account(spark):
    from retentia.config import DEFAULT_CONFIG
    from retentia.operators.explain import ExplanationBasis, top_factors

    feats = QUERIES["renewal_features"](spark, SF_SMALL)
    basis = ExplanationBasis(tuple(DEFAULT_CONFIG.model_features), (), tuple(1.0 for _ in DEFAULT_CONFIG.model_features))
    base_plan = _plan(feats)
    plan = _plan(top_factors(feats, basis, 5))
    # the top-k adds no exchange and no window on top of the feature plan
    assert plan.count("Exchange") <= base_plan.count("Exchange")
    assert "Window" not in plan


def test_sides_of_the_split_are_pruned_folders(spark):
    from retentia.plans.catalog import split_features

    plan = _plan(split_features(spark, SF_SMALL).where("split = 'test'").select("account_id", "split"))
    assert plan.count("Scan parquet") == 2 and "PartitionFilters: [isnotnull(split" in plan  # tree and details
    assert "Exchange" not in plan and "Window" not in plan
