import numpy as np
import pytest
from pyspark.sql import functions as F

from retentia.operators import metrics as M

# The published run: confusion matrix [[204, 85], [31, 530]] at 0.5.
PUBLISHED = {
    "accuracy": 0.8635294117647059,
    "precision": 0.8617886178861789,
    "recall": 0.9447415329768271,
    "f1": 0.9013605442176871,
}
REPORT = {
    "0": (0.8680851063829788, 0.7058823529411765, 0.7786259541984732, 289.0),
    "1": (0.8617886178861789, 0.9447415329768271, 0.9013605442176871, 561.0),
    "macro avg": (0.8649368621345788, 0.8253119429590018, 0.8399932492080802, 850.0),
    "weighted avg": (0.8639294239750908, 0.8635294117647059, 0.8596307836111544, 850.0),
}


@pytest.fixture(scope="module")
def published(spark):
    rows = [(0, 0)] * 204 + [(0, 1)] * 85 + [(1, 0)] * 31 + [(1, 1)] * 530
    return spark.createDataFrame(rows, "y int, p int")


def test_confusion_matrix_published(published):
    cm = {(r["actual"], r["predicted"]): r["count"] for r in M.confusion_matrix(published, "y", "p").collect()}
    assert cm == {(0, 0): 204, (0, 1): 85, (1, 0): 31, (1, 1): 530}


def test_binary_metrics_published_exact(published):
    got = M.binary_metrics(published, "y", "p").first().asDict()
    assert got == PUBLISHED


def test_classification_report_published_exact(published):
    rows = {r["label"]: (r["precision"], r["recall"], r["f1_score"], r["support"]) for r in M.classification_report(published, "y", "p").collect()}
    for k, v in REPORT.items():
        assert rows[k] == v, k
    assert rows["accuracy"][0] == PUBLISHED["accuracy"]


def test_zero_division_gives_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    got = M.binary_metrics(df, "y", "p").first()
    assert got["precision"] == 0.0 and got["recall"] == 0.0 and got["f1"] == 0.0


def _brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def _brute_ap(y, s):
    order = np.unique(s)[::-1]
    total, ap = y.sum(), 0.0
    for t in order:
        sel = s >= t
        tp, fp = (y[sel] == 1).sum(), (y[sel] == 0).sum()
        gained = ((s == t) & (y == 1)).sum()
        ap += gained / total * tp / (tp + fp)
    return ap


def test_roc_auc_and_ap_against_brute_force_with_ties(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 2000)
    s = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)  # many ties
    df = spark.createDataFrame([(int(a), float(b), int(i % 2)) for i, (a, b) in enumerate(zip(y, s))], "y int, s double, g int")
    assert M.roc_auc(df, "y", "s").first()["roc_auc"] == pytest.approx(_brute_auc(y, s), abs=1e-12)
    assert M.average_precision(df, "y", "s").first()["average_precision"] == pytest.approx(_brute_ap(y, s), abs=1e-12)
    by = {r["g"]: r["roc_auc"] for r in M.roc_auc(df, "y", "s", ["g"]).collect()}
    g = np.arange(len(y)) % 2
    for k in (0, 1):
        assert by[k] == pytest.approx(_brute_auc(y[g == k], s[g == k]), abs=1e-12)


def test_roc_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.5)], "y int, s double")
    assert M.roc_auc(df, "y", "s").first()["roc_auc"] is None


def test_ranking_metrics_of_billions(spark, monkeypatch):
    from retentia.operators import metrics as M

    n = 3_000_000_000
    counts = spark.createDataFrame([(0.2, 0, n), (0.8, n, 0)], "p double, pos long, neg long")
    monkeypatch.setattr(M, "score_counts", lambda *a, **k: counts)
    row = M.ranking_metrics(spark.range(1), "y", "p").first()
    assert row["roc_auc"] == 1.0 and row["average_precision"] == 1.0


def test_positive_class_zero(spark):
    from retentia.operators import metrics as M

    df = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.4), (1, 1, 0.2), (1, 1, 0.1)], "y int, pred int, p double")
    assert M.confusion_counts(df, "y", "pred", positive=0).first().asDict() == {"tn": 2, "fp": 0, "fn": 1, "tp": 1}
    assert M.roc_auc(df, "y", "p", positive=0).first()["roc_auc"] == 1.0
