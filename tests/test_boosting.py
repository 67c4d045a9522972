"""Models grown together against Spark ML's classifier and against each other."""

import math
import os

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from retentia.config import DEFAULT_CONFIG
from retentia.operators import boosting
from retentia.operators.boosting import Boosted, best_splits, bin_edges, grow_together
from retentia.plans import training as TR
from retentia.session import ordered_checkpoint

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    """900 rows: a steep and a many-valued feature, one with a value that a
    third of the rows hold, a constant one; a noisy label; three folds."""
    rng = np.random.default_rng(11)
    n = 900
    a, b = rng.integers(0, 12, n).astype(float), rng.normal(size=n)
    c = np.where(rng.random(n) < 0.35, 0.0, rng.exponential(size=n))
    label = (a - 6 + 3 * b - 4 * c + rng.normal(size=n) * 2 > -2).astype(float)
    rows = [(i, float(a[i]), float(b[i]), float(c[i]), 5.0, float(label[i]), i % 3) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, label double, fold int")
    return ordered_checkpoint(df.repartition(3, "id").sortWithinPartitions("id"))


def values_of(df):
    pdf = df.select(*FEATURES).toPandas()
    return pdf.to_numpy(dtype=float)


@pytest.mark.parametrize("trees, step, depth, min_rows", [(1, 0.1, 2, 1), (25, 0.1, 3, 4), (12, 0.25, 5, 20)])
def test_a_model_is_that_of_the_spark_classifier(table, trees, step, depth, min_rows):
    grown = grow_together(table, FEATURES, "label", "id", [Boosted(trees, step, depth, min_rows)])
    gbt = GBTClassifier(featuresCol="f", labelCol="label", maxIter=trees, stepSize=step, maxDepth=depth, minInstancesPerNode=min_rows)
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="f"), gbt]).fit(table)
    want = model.transform(table).select(*FEATURES, vector_to_array("probability")[1].alias("p")).toPandas()
    got = grown.probabilities(want[FEATURES].to_numpy(dtype=float), 0)
    assert np.abs(got - want["p"].to_numpy()).max() < 1e-9


@pytest.mark.parametrize("block_rows", [8_192, 250])  # in one task, in several
def test_models_grown_together_are_those_grown_alone(spark, table, monkeypatch, block_rows):
    monkeypatch.setattr(boosting, "CHECKPOINT_TREES", 2)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", block_rows)
    specs = [
        Boosted(7, 0.1, 2, held_out=0, seed=3),
        Boosted(4, 0.2, 4, 5, row_share=0.7, held_out=1, seed=3),
        Boosted(9, 0.3, 3, 2, row_share=0.9, features=2, held_out=2, seed=4),
        Boosted(1, 0.3, 1),
    ]
    together = grow_together(table, FEATURES, "label", "id", specs, "fold")
    x = values_of(table)
    for m, spec in enumerate(specs):
        alone = grow_together(table, FEATURES, "label", "id", [spec], "fold")
        assert np.array_equal(alone.probabilities(x, 0), together.probabilities(x, m))
        if spec.held_out is not None:
            # the fold it has not seen changes nothing
            others = table.withColumn("label", F.when(F.col("fold") == spec.held_out, 1 - F.col("label")).otherwise(F.col("label")))
            blind = grow_together(others, FEATURES, "label", "id", [spec], "fold")
            assert np.array_equal(blind.probabilities(x, 0), together.probabilities(x, m))


def test_held_out_scores_are_the_models_own(spark, table):
    specs = [Boosted(5, 0.1, 3, held_out=k) for k in range(3)]
    grown = grow_together(table, FEATURES, "label", "id", specs, "fold")
    held = grown.held_out_scores(spark).toPandas()
    for k in range(3):
        rows = table.where(F.col("fold") == k).toPandas()
        want = sorted(zip(rows["label"].astype(int), grown.probabilities(rows[FEATURES].to_numpy(dtype=float), k)))
        part = held[held["model"] == k]
        got = sorted(zip(part["label"], part["score"]))
        assert [g[0] for g in got] == [w[0] for w in want]
        assert np.allclose([g[1] for g in got], [w[1] for w in want], rtol=0, atol=1e-12)


def test_draws_depend_on_rows_and_seed_alone(table):
    spec = Boosted(6, 0.2, 3, row_share=0.5, features=2, seed=9)
    x = values_of(table)
    first = grow_together(table, FEATURES, "label", "id", [spec]).probabilities(x, 0)
    other = ordered_checkpoint(table.repartition(5, "a").sortWithinPartitions("b"))
    assert np.allclose(grow_together(other, FEATURES, "label", "id", [spec]).probabilities(x, 0), first, rtol=0, atol=1e-9)
    reseeded = Boosted(6, 0.2, 3, row_share=0.5, features=2, seed=10)
    assert not np.allclose(grow_together(table, FEATURES, "label", "id", [reseeded]).probabilities(x, 0), first)


def test_row_draws_have_their_share():
    key = boosting._hashed(np.arange(20_000, dtype=np.uint64))
    drawn = [boosting._draw(key, 5, t) < 0.7 for t in range(3)]
    assert all(abs(d.mean() - 0.7) < 0.02 for d in drawn)
    assert abs((drawn[0] & drawn[1]).mean() - 0.49) < 0.02


def test_feature_draws_have_their_number():
    allowed = boosting._allowed(Boosted(1, 0.1, 5, features=4, seed=2), 3, 4, 12)
    assert allowed.shape == (16, 12) and (allowed.sum(axis=1) == 4).all() and len({tuple(r) for r in allowed}) > 8


def test_nulls_are_largest_and_rows_without_label_take_no_part(spark):
    rows = [(i, float(i // 2 % 4), None if i % 2 else 1.0, float(i % 2)) for i in range(40)]
    rows += [(100 + i, 9.0, 1.0, None) for i in range(50)] + [(200, float("nan"), float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label double").coalesce(1)
    grown = grow_together(df, ["a", "b"], "label", "id", [Boosted(3, 0.3, 2)])
    got = grown.probabilities(np.array([[0.0, 1.0], [0.0, math.nan]]), 0)
    assert got[0] < 0.5 < got[1]
    assert grown.edges[0].tolist() == [0.5, 1.5, 2.5, 3.0] and grown.edges[1].tolist() == [1.0]


def test_no_rows_no_splits(spark):
    schema = "id long, a double, label double, fold int"
    empty = spark.createDataFrame([], schema)
    grown = grow_together(empty, ["a"], "label", "id", [Boosted(2, 0.1, 2, held_out=0)], "fold")
    assert grown.held_out_scores(spark).count() == 0 and grown.probabilities(np.array([[1.0]]), 0).tolist() == [0.5]
    one_class = spark.createDataFrame([(i, 1.0, 1.0, i % 2) for i in range(10)], schema)
    grown = grow_together(one_class, ["a"], "label", "id", [Boosted(2, 0.1, 2, held_out=0)], "fold")
    assert {r.score > 0.8 for r in grown.held_out_scores(spark).collect()} == {True}


def test_bin_edges():
    assert bin_edges(np.array([3.0, 1.0, 2.0, 2.0, np.nan]), 32).tolist() == [1.5, 2.5, 3.0]
    assert bin_edges(np.array([7.0, 7.0]), 32).tolist() == []
    many = bin_edges(np.arange(1000.0), 10)
    assert many.tolist() == [99.5 + 100 * i for i in range(9)]


def test_best_splits_by_hand():
    histogram = np.zeros((2, 2, 1, 3))
    histogram[0, 0, 0], histogram[1, 0, 0] = [-4, 2, 3], [4, 2, 4]  # sums, rows of the first node
    every = np.ones((2, 1), dtype=bool)
    assert best_splits(histogram, 1, every) == [(0, 0, 0, 0.1, -1.0, 5 / 6)]
    assert best_splits(histogram, 5, every)[0][:2] == (0, -1)
    assert best_splits(histogram, 1, ~every)[0][:2] == (0, -1)


def test_old_checkpoints_go(spark, table, monkeypatch, tmp_path):
    monkeypatch.setattr(boosting, "CHECKPOINT_TREES", 1)
    saved = []
    monkeypatch.setattr(boosting, "_forget", lambda sc, path, forget=boosting._forget: (saved.append(path), forget(sc, path)))
    grow_together(table, FEATURES, "label", "id", [Boosted(5, 0.1, 1)])
    gone = [p.removeprefix("file:") for p in saved if p]
    assert gone and not any(os.path.exists(p) for p in gone)


def test_metric_of_every_model(spark):
    rows = [(0, 1, 0.9), (0, 0, 0.8), (0, 1, 0.3), (0, 0, 0.1), (1, 1, 0.6), (1, 1, 0.2)]
    held = spark.createDataFrame(rows, "model int, label int, score double")
    value = lambda metric: {r["model"]: r["value"] for r in TR.held_out_metric(held, metric).collect()}
    assert value("roc_auc") == {0: 0.75, 1: None}
    assert value("average_precision")[0] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)  # steps, not the trapezoid
    assert value("accuracy") == {0: 0.5, 1: 0.5} and value("precision") == {0: 0.5, 1: 1.0}
    assert value("recall") == {0: 0.5, 1: 0.5} and value("f1")[1] == pytest.approx(2 / 3)
    with pytest.raises(ValueError, match="unknown training metric"):
        TR.held_out_metric(held, "other")


def test_search_reports_every_fold(spark, table):
    cfg = DEFAULT_CONFIG.with_(gbt_ranges=(("n_estimators", (5, 8)),) + DEFAULT_CONFIG.gbt_ranges[1:])
    from test_training import _signal

    train = TR.materialized_training_table(_signal(spark, 400), cfg)
    result = TR.search(train, cfg, n_trials=4)
    assert len(result.folds) == 4 and [len(f) for f in result.folds] == [3] * 4
    for score, folds in zip(result.scores, result.folds):
        assert sum(n for n, _, _ in folds) == 400 and score == pytest.approx(np.mean([v for *_, v in folds]))
    assert result.best_score == max(result.scores) > 0.7
    assert result.best_params == result.trials[result.scores.index(result.best_score)]


@pytest.mark.parametrize("compared", [16, 0])  # cuts compared by whole rows, or looked up
def test_histograms_of_a_level_are_those_of_its_rows_with_one_draw_for_all_models(monkeypatch, compared):
    monkeypatch.setattr(boosting, "COMPARED_NODES", compared)
    draws = []
    monkeypatch.setattr(boosting, "_draw", lambda key, seed, tree, draw=boosting._draw: (draws.append(seed), draw(key, seed, tree))[1])
    rng = np.random.default_rng(2)
    n, n_bins = 500, 6
    block = boosting.Block(
        rng.integers(0, n_bins, (5, n)).astype(np.uint8), rng.choice([-1.0, 1.0], n), rng.integers(0, 3, n).astype(np.int16),
        rng.integers(0, 2**62, n).astype(np.uint64), rng.normal(size=(4, n)),
    )
    specs = [Boosted(3, 0.2, 3, row_share=0.6, held_out=k, features=f, seed=7) for k, f in ((0, None), (1, None), (2, 2), (None, 2))]
    trees = boosting.Trees.stumps(4, 3)
    trees.value[:] = rng.normal(size=trees.value.shape)
    for m in range(4):  # of the second level one node is a leaf
        trees.feature[m, :3], trees.cut[m, :3] = (m, 4, -1), (2, 1, 0)
    ends = []
    for m in range(4):
        node = np.zeros(n, dtype=int)
        for i in range(n):
            while trees.feature[m, node[i]] >= 0:
                node[i] = 2 * node[i] + 1 + (block.bins[trees.feature[m, node[i]], i] > trees.cut[m, node[i]])
        ends.append(node)
        assert np.array_equal(trees.outputs(block.bins, m, 0.5), 0.5 * trees.value[m, node])
    for level, first in ((0, 0), (2, 3)):
        draws.clear()
        columns = {m: boosting._columns(boosting._allowed(specs[m], 1, level, 5)) for m in range(4)}
        assert [c.shape[1] for c in columns.values()] == [5, 5, 3, 3]
        got = dict(boosting._histograms(block, specs, trees, 1, level, columns, n_bins))
        assert draws == [7]
        for m, spec in enumerate(specs):
            node = ends[m] if level else np.zeros(n, dtype=int)
            take = (block.fold != spec.held_out) & (boosting._hashed(block.key ^ boosting._hashed(np.array([(7 << 20) + 2], dtype=np.uint64))) >> np.uint64(11) < 0.6 * 2**53)
            want = np.zeros((2, 2**level, columns[m].shape[1], n_bins))
            for i in np.flatnonzero(take & (node >= first)):
                for j, feature in enumerate(columns[m][node[i] - first]):
                    y = block.label[i]
                    want[0, node[i] - first, j, block.bins[feature, i]] += 4 * y / (1 + np.exp(2 * y * block.scores[m, i]))
                    want[1, node[i] - first, j, block.bins[feature, i]] += 1
            assert np.array_equal(got[m][1], want[1]) and np.allclose(got[m][0], want[0], rtol=1e-12, atol=1e-12)


def by_level(monkeypatch, *args):
    """The models of a distributed table, one job a level."""
    with monkeypatch.context() as m:
        m.setattr(boosting, "WHOLE_ROWS", -1)
        return grow_together(*args)


def same_models(one, other):
    assert len(one.forest) == len(other.forest)
    for a, b in zip(one.forest, other.forest):
        assert np.array_equal(a.feature, b.feature) and np.array_equal(a.cut, b.cut) and np.array_equal(a.value, b.value)


def held_rows(grown, spark):
    return sorted(tuple(r) for r in grown.held_out_scores(spark).collect())


# rounded residuals in one chunk, in several, features apart; plain ones in one task, in several
@pytest.mark.parametrize("plain_rows, block_rows, chunk_rows, joint_cells", [(0, 8_192, 32_768, 1_024), (0, 250, 70, 40), (0, 250, 70, 1), (900, 8_192, 70, 40), (900, 250, 70, 40)])
def test_whole_models_are_those_grown_by_level(spark, table, monkeypatch, plain_rows, block_rows, chunk_rows, joint_cells):
    monkeypatch.setattr(boosting, "PLAIN_ROWS", plain_rows)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(boosting, "CHUNK_ROWS", chunk_rows)
    monkeypatch.setattr(boosting, "JOINT_CELLS", joint_cells)
    gaps = table.withColumn("b", F.when(F.col("id") % 7 > 0, F.col("b"))).withColumn("label", F.when(F.col("id") % 11 > 0, F.col("label")))
    specs = [
        Boosted(7, 0.1, 2, held_out=0, seed=3),
        Boosted(4, 0.2, 5, 5, row_share=0.7, held_out=1, seed=3),
        Boosted(9, 0.3, 3, 2, row_share=0.9, features=2, held_out=2, seed=4),
        Boosted(3, 0.3, 4, 1, features=1, held_out=9, seed=5),
        Boosted(1, 0.3, 1),
    ]
    args = gaps, FEATURES, "label", "id", specs, "fold"
    whole, level = grow_together(*args), by_level(monkeypatch, *args)
    same_models(whole, level)
    held = held_rows(whole, spark)
    assert held == held_rows(level, spark) and {r[0] for r in held} == {0, 1, 2}
    whole.release(), level.release()


def test_the_models_of_a_table_that_a_task_holds_need_no_job_a_level(table, monkeypatch):
    levels = []
    monkeypatch.setattr(boosting, "_level", lambda *args, level=boosting._level: (levels.append(args), level(*args))[1])
    specs = [Boosted(20, 0.1, 3, held_out=k) for k in range(3)]
    grow_together(table, FEATURES, "label", "id", specs, "fold")
    assert not levels
    deep = [Boosted(2, 0.1, boosting.WHOLE_DEPTH + 1, held_out=k) for k in range(2)]
    grow_together(table, FEATURES, "label", "id", deep, "fold")
    assert levels


def test_models_do_not_depend_on_the_layout(table, monkeypatch):
    monkeypatch.setattr(boosting, "PLAIN_ROWS", 0)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    specs = [Boosted(12, 0.2, 4, row_share=0.8, features=f, held_out=k, seed=9) for k, f in ((0, None), (1, 2))]
    other = ordered_checkpoint(table.repartition(5, "a").sortWithinPartitions("b"))
    first = grow_together(table, FEATURES, "label", "id", specs, "fold")
    same_models(grow_together(other, FEATURES, "label", "id", specs, "fold"), first)
    same_models(by_level(monkeypatch, other, FEATURES, "label", "id", specs, "fold"), first)


@pytest.mark.parametrize("plain_rows", [0, 900])
def test_whole_models_without_rows_or_classes(spark, monkeypatch, plain_rows):
    monkeypatch.setattr(boosting, "PLAIN_ROWS", plain_rows)
    schema = "id long, a double, label double, fold int"
    specs = [Boosted(2, 0.1, 2, held_out=k) for k in range(2)]
    empty = grow_together(spark.createDataFrame([], schema), ["a"], "label", "id", specs, "fold")
    assert empty.held_out_scores(spark).count() == 0 and empty.probabilities(np.array([[1.0]]), 1).tolist() == [0.5]
    one_fold = spark.createDataFrame([(i, float(i % 3), float(i % 2), 0) for i in range(10)], schema)
    grown = grow_together(one_fold, ["a"], "label", "id", specs, "fold")
    assert [(r.model, r.score) for r in grown.held_out_scores(spark).collect()] == [(0, 0.5)] * 10


def test_sums_of_residuals_are_exact():
    rng = np.random.default_rng(4)
    assert boosting.residual_unit(0) == boosting.residual_unit(boosting.PLAIN_ROWS) == 0.0
    for rows in (boosting.PLAIN_ROWS + 1, 1 << 20, 4_320_000):
        unit = boosting.residual_unit(rows)
        y, score = rng.choice([-1.0, 1.0], 10_000), rng.normal(size=10_000) * 3
        residual = boosting._residuals_at(y, score, unit)
        assert np.array_equal(np.rint(residual / unit) * unit, residual)
        assert np.abs(residual - boosting._residuals_at(y, score, 0.0)).max() <= unit / 2
        assert 4 * rows / unit <= 2**53  # every sum of them is a whole number of units that a double holds
    assert boosting.residual_unit(10**12) == 2.0**-28


def test_row_draws_are_the_same_as_whole_numbers():
    key = boosting._hashed(np.arange(5_000, dtype=np.uint64))
    for share in (0.7, 0.123456789, 1 - 2.0**-53, 2.0**-60):
        assert np.array_equal(boosting._drawn(key, 5, 3, share), boosting._draw(key, 5, 3) < share)


def test_joint_groups_hold_every_feature_once(monkeypatch):
    monkeypatch.setattr(boosting, "JOINT_CELLS", 60)
    sizes = [10, 2, 33, 6, 5, 70]
    groups = boosting._joint(sizes)
    assert sorted(f for g in groups for f in g) == list(range(6)) and [5] in groups
    assert all(len(g) == 1 or math.prod(sizes[f] for f in g) <= 60 for g in groups) and len(groups) < 6


def test_a_search_takes_few_jobs_however_many_trees(spark, table):
    ranges = (("n_estimators", (60, 60)), ("learning_rate", (0.1, 0.2)), ("max_depth", (2, 2)))
    cfg = DEFAULT_CONFIG.with_(gbt_ranges=ranges + DEFAULT_CONFIG.gbt_ranges[3:])
    from test_training import _signal

    train = TR.materialized_training_table(_signal(spark, 200), cfg)
    sc = spark.sparkContext
    sc.setJobGroup("search", "search")
    result = TR.search(train, cfg, n_trials=2)
    jobs = len(sc.statusTracker().getJobIdsForGroup("search"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert [sum(n for n, _, _ in folds) for folds in result.folds] == [200, 200]
    assert 0 < jobs < 60, jobs
