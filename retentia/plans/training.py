"""Model training, tuning, evaluation, bundle storage and batch scoring.

Spark ML replaces the single-machine boosted trees:

* ``VectorAssembler`` over the 12 model features (never the id or label);
* ``GBTClassifier`` with the original's parameters mapped as
  n_estimators -> maxIter, learning_rate -> stepSize, max_depth -> maxDepth,
  min_samples_leaf -> minInstancesPerNode, subsample -> subsamplingRate,
  max_features sqrt / log2 / None -> featureSubsetStrategy sqrt / log2 / all,
  random_state -> seed. ``min_samples_split`` has no MLlib twin; it is
  approximated by ``minInstancesPerNode = max(leaf, ceil(split / 2))``.
  MLlib bins features (``maxBins``), so scores are not bit-equal;
* tuning: a seeded random draw of N parameter maps (log-uniform learning
  rate) cross-validated on our stratified folds with the mean of the
  configured metric (exact ROC-AUC by default); the models of all candidates
  and folds grow together, one job a tree level (``operators.boosting``, which
  gives the model of ``GBTClassifier`` where nothing is drawn);
  N <= 1 takes the first value of every range (the default path, which is
  what the published run used);
* evaluation with the distributed metric operators at threshold 0.5;
* a bundle is a folder of versions, each a saved ``PipelineModel`` plus a
  one-row JSON metadata table (feature names, inputs, threshold, label map,
  exact training medians, importances), written and read through Spark so it
  works on any shared file system. The metadata is written last and marks a
  version as whole; readers take the newest whole one, so publishing never
  leaves half a model to be served.

MLlib draws its row samples per partition, so a model depends on how its table
is laid out. The training table therefore has a layout of its own: rows are
dealt by a hash of the id into a number of partitions that follows from the
row count alone, ordered inside each, and checkpointed (a lost executor then
re-reads it). Equal rows and seed give equal models, however the input was
partitioned.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass, field
from typing import Any, Mapping

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_CONFIG, RenewalConfig
from ..functions.columns import q6
from ..operators import boosting
from ..operators import metrics as metric_ops
from ..operators import scoring as score_ops
from ..operators.explain import ExplanationBasis, fit_basis, top_factor_list
from ..operators.features import model_frame
from ..operators.quantiles import collect_medians
from ..operators.split import FOLD, cv_folds
from ..session import ordered_checkpoint, stored

LABEL_COL = "_label"
FEATURES_COL = "_features"


class NoBundle(LookupError):
    """The folder holds no whole version of a model bundle."""


# -- parameters -----------------------------------------------------------------


def default_params(config: RenewalConfig = DEFAULT_CONFIG) -> dict[str, Any]:
    """First value of every range."""
    return {k: v[0] for k, v in config.gbt_space.items()}


def sample_params(config: RenewalConfig, n: int, seed: int) -> list[dict[str, Any]]:
    """Seeded random search space draws (driver side, n small dicts)."""
    rng = np.random.default_rng(seed)
    space = config.gbt_space
    draws = []
    for _ in range(n):
        lo, hi = space["learning_rate"]
        draws.append(
            {
                "n_estimators": int(rng.integers(space["n_estimators"][0], space["n_estimators"][1] + 1)),
                "learning_rate": float(math.exp(rng.uniform(math.log(lo), math.log(hi)))),
                "max_depth": int(rng.integers(space["max_depth"][0], space["max_depth"][1] + 1)),
                "min_samples_split": int(rng.integers(space["min_samples_split"][0], space["min_samples_split"][1] + 1)),
                "min_samples_leaf": int(rng.integers(space["min_samples_leaf"][0], space["min_samples_leaf"][1] + 1)),
                "subsample": float(rng.uniform(space["subsample"][0], space["subsample"][1])),
                "max_features": space["max_features"][int(rng.integers(0, len(space["max_features"])))],
            }
        )
    return draws


def gbt_settings(params: Mapping[str, Any], seed: int) -> dict[str, Any]:
    strategy = params.get("max_features")
    leaf = int(params.get("min_samples_leaf", 1))
    split = int(params.get("min_samples_split", 2))
    return {
        "maxIter": int(params["n_estimators"]),
        "stepSize": float(params["learning_rate"]),
        "maxDepth": int(params["max_depth"]),
        "minInstancesPerNode": max(leaf, math.ceil(split / 2)),
        "subsamplingRate": float(params["subsample"]),
        "featureSubsetStrategy": strategy if strategy in ("sqrt", "log2") else "all",
        "seed": int(seed),
    }


def build_pipeline(config: RenewalConfig = DEFAULT_CONFIG) -> tuple[Pipeline, GBTClassifier]:
    assembler = VectorAssembler(inputCols=list(config.model_features), outputCol=FEATURES_COL, handleInvalid="keep")
    gbt = GBTClassifier(featuresCol=FEATURES_COL, labelCol=LABEL_COL, seed=config.random_state)
    return Pipeline(stages=[assembler, gbt]), gbt


def param_map(gbt: GBTClassifier, params: Mapping[str, Any], seed: int) -> dict:
    return {getattr(gbt, k): v for k, v in gbt_settings(params, seed).items()}


# Layout of a training table: its partitions follow from its rows alone.
TRAINING_PARTITION_ROWS = 20_000
LEAST_TRAINING_PARTITIONS = 2


def training_table(features: DataFrame, config: RenewalConfig = DEFAULT_CONFIG) -> DataFrame:
    """Model frame + numeric label column (1.0: the positive class), with the
    id kept for folds."""
    frame = model_frame(features, config, keep=[config.id_column, config.target])
    return frame.withColumn(LABEL_COL, (F.col(config.target) == config.positive_class).cast(T.DoubleType()))


def laid_out(df: DataFrame, config: RenewalConfig = DEFAULT_CONFIG) -> DataFrame:
    """The rows in a layout that depends on the rows alone, checkpointed."""
    table = stored(df, "training_rows")
    partitions = max(LEAST_TRAINING_PARTITIONS, math.ceil(table.count() / TRAINING_PARTITION_ROWS))
    others = [c for c in sorted(table.columns) if c != config.id_column]
    dealt = table.repartition(partitions, config.id_column).sortWithinPartitions(config.id_column, *others)
    return ordered_checkpoint(dealt)


def materialized_training_table(features: DataFrame, config: RenewalConfig = DEFAULT_CONFIG) -> DataFrame:
    return laid_out(training_table(features, config), config)


# -- search -----------------------------------------------------------------------


@dataclass
class SearchResult:
    trials: list[dict[str, Any]]
    scores: list[float]
    best_params: dict[str, Any]
    best_score: float
    #: per trial and fold: rows, positives and the metric of the held-out rows
    folds: list[list[tuple[int, int, float]]] = field(default_factory=list)


RANKING_METRICS = ("roc_auc", "average_precision")
THRESHOLD_METRICS = ("accuracy", "f1", "precision", "recall")


def held_out_metric(held: DataFrame, metric: str) -> DataFrame:
    """(model, value) of (model, label, score); ranking metrics are exact, the
    others are those of the positive class at a threshold of one half. Null
    where the metric has no value (ROC-AUC of one class)."""
    if metric in RANKING_METRICS:
        values = metric_ops.ranking_metrics(held, "label", "score", ["model"])
    elif metric in THRESHOLD_METRICS:
        predicted = held.withColumn("predicted", (F.col("score") >= 0.5).cast(T.IntegerType()))
        values = metric_ops.binary_metrics(predicted, "label", "predicted", ["model"])
    else:
        raise ValueError(f"unknown training metric: {metric}")
    return values.select("model", F.col(metric).alias("value"))


def boosted_spec(params: Mapping[str, Any], config: RenewalConfig, held_out: int | None = None) -> boosting.Boosted:
    """A candidate as ``GBTClassifier`` would be set (``gbt_settings``)."""
    s, n = gbt_settings(params, config.random_state), len(config.model_features)
    drawn = {"sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n)))}
    return boosting.Boosted(
        trees=s["maxIter"],
        step=s["stepSize"],
        depth=s["maxDepth"],
        min_rows=s["minInstancesPerNode"],
        row_share=s["subsamplingRate"],
        features=drawn.get(s["featureSubsetStrategy"]),
        held_out=held_out,
        seed=s["seed"],
    )


def cross_validate(train: DataFrame, candidates: list[dict[str, Any]], config: RenewalConfig = DEFAULT_CONFIG) -> SearchResult:
    """Mean metric of every candidate over the stratified folds.

    The models of all candidates and folds grow together: the number of jobs
    is that of the longest model. Their scores of held-out rows are one table,
    on which the metric of every model is one aggregation.
    """
    if config.cv_metric not in RANKING_METRICS + THRESHOLD_METRICS:
        raise ValueError(f"unknown training metric: {config.cv_metric}")
    folded = laid_out(cv_folds(train, config), config)
    k = config.cv_folds
    specs = [boosted_spec(p, config, fold) for p in candidates for fold in range(k)]
    grown = boosting.grow_together(folded, config.model_features, LABEL_COL, config.id_column, specs, FOLD)
    held = stored(grown.held_out_scores(folded.sparkSession), "held_out")
    grown.release()
    sizes = {r["model"]: (r["n"], r["p"]) for r in held.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).collect()}
    values = {r["model"]: r["value"] for r in held_out_metric(held, config.cv_metric).collect()}
    folds, scores = [], []
    for i in range(len(candidates)):
        models = range(i * k, (i + 1) * k)
        value = [math.nan if values.get(m) is None else float(values[m]) for m in models]
        folds.append([(*sizes.get(m, (0, 0)), v) for m, v in zip(models, value)])
        known = [v for v in value if not math.isnan(v)]
        scores.append(float(np.mean(known)) if known else math.nan)
    best = max(range(len(scores)), key=lambda i: -math.inf if math.isnan(scores[i]) else scores[i])
    return SearchResult(candidates, scores, candidates[best], scores[best], folds)


def search(train: DataFrame, config: RenewalConfig = DEFAULT_CONFIG, n_trials: int | None = None) -> SearchResult:
    """Random search when more than one trial is asked, else the default
    parameters probed by cross-validation. ``n_trials`` of 0 / None falls
    back to the configured count, as in the original."""
    requested = n_trials or config.n_trials
    if requested > 1:
        candidates = sample_params(config, requested, config.random_state)
    else:
        candidates = [default_params(config)]
    return cross_validate(train, candidates, config)


# -- bundle -------------------------------------------------------------------------


@dataclass
class Bundle:
    model: PipelineModel
    metadata: dict[str, Any]
    best_params: dict[str, Any] = field(default_factory=dict)
    metrics: dict[str, Any] = field(default_factory=dict)
    #: name of the stored version it was loaded from
    version: str = ""


def importances(model: PipelineModel, config: RenewalConfig = DEFAULT_CONFIG) -> dict[str, float]:
    values = model.stages[-1].featureImportances.toArray().tolist()
    return dict(zip(config.model_features, (float(v) for v in values)))


def make_bundle(model: PipelineModel, train: DataFrame, config: RenewalConfig, best: dict, metrics: dict) -> Bundle:
    meta = {
        "feature_names": list(config.model_features),
        "input_features": list(config.input_features),
        "target": config.target,
        "positive_label": config.positive_class,
        "prediction_threshold": config.prediction_threshold,
        "label_map": {str(k): v for k, v in config.label_map},
        "training_feature_medians": collect_medians(train, config.model_features),
        "feature_importances": importances(model, config),
    }
    return Bundle(model, meta, best, metrics)


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Whole versions of a bundle folder, oldest first."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    store = folder.getFileSystem(conf)
    if not store.exists(folder):
        return []
    names = sorted(status.getPath().getName() for status in store.listStatus(folder))
    whole = lambda n: store.exists(jvm.org.apache.hadoop.fs.Path(folder, f"{n}/metadata/_SUCCESS"))
    return [f"{path}/versions/{n}" for n in names if whole(n)]


def save_bundle(bundle: Bundle, path: str) -> str:
    """A new version of the bundle under ``path``; the metadata comes last."""
    spark = SparkSession.getActiveSession()
    version = f"{path}/versions/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    bundle.model.write().save(f"{version}/model")
    doc = json.dumps({"metadata": bundle.metadata, "best_params": bundle.best_params, "metrics": bundle.metrics})
    spark.createDataFrame([(doc,)], "value string").coalesce(1).write.text(f"{version}/metadata")
    return version


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    """The newest whole version under ``path``."""
    versions = _versions(spark, path)
    if not versions:
        raise NoBundle(f"no model bundle in {path}; train or publish one first")
    parsed = json.loads(spark.read.text(f"{versions[-1]}/metadata").first()["value"])
    model = PipelineModel.load(f"{versions[-1]}/model")
    version = versions[-1].rsplit("/", 1)[-1]
    return Bundle(model, parsed["metadata"], parsed.get("best_params", {}), parsed.get("metrics", {}), version)


def publish_bundle(spark: SparkSession, source: str, destination: str) -> str:
    """The newest bundle of ``source`` as a new version of ``destination``;
    what is served until then stays as it is."""
    save_bundle(load_bundle(spark, source), destination)
    load_bundle(spark, destination)
    return destination


# -- scoring and evaluation -----------------------------------------------------------


def _with_probability(out: DataFrame) -> DataFrame:
    """The probability of the positive class. Labels are encoded as 1.0 for
    it (``training_table``), whatever its value is in the source."""
    if "probability" in out.columns:
        return out.withColumn(score_ops.PROBABILITY, vector_to_array("probability")[1])
    # a model without probabilities: 1.0 / 0.0 from the label
    return out.withColumn(score_ops.PROBABILITY, F.when(F.col("prediction") == 1.0, 1.0).otherwise(0.0))


def _labelled(scored: DataFrame, bundle: Bundle, config: RenewalConfig) -> DataFrame:
    names = {int(k): v for k, v in bundle.metadata.get("label_map", dict(config.label_map)).items()}
    threshold = float(bundle.metadata.get("prediction_threshold", config.prediction_threshold))
    return score_ops.add_predictions(scored, config.with_(prediction_threshold=threshold, label_map=tuple(names.items())))


def score(bundle: Bundle, df: DataFrame, config: RenewalConfig = DEFAULT_CONFIG, keep: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """Probability of the positive class, label and label name per row, with
    the model features and the columns in ``keep``.

    ``df`` may hold raw inputs (features are built) or the 12 features
    (used as they are). Works on batch and streaming DataFrames: the fitted
    pipeline is a row-wise transformation. The target is not needed.
    """
    keep = tuple(c for c in keep if c in df.columns)
    frame = model_frame(df, config, keep=list(keep))
    out = _with_probability(bundle.model.transform(frame))
    return _labelled(out.select(*keep, *config.model_features, score_ops.PROBABILITY), bundle, config)


def score_accounts(bundle: Bundle, accounts: DataFrame, config: RenewalConfig = DEFAULT_CONFIG) -> DataFrame:
    """The rows of ``accounts``, all columns as they are, with the predictions
    appended. Features are built from copies, so that inputs and features of
    the same name don't meet."""
    copies = {c: f"_raw_{i}" for i, c in enumerate(accounts.columns)}
    both = accounts.select("*", *[F.col(f"`{c}`").alias(n) for c, n in copies.items()])
    scored = score(bundle, both, config, keep=tuple(copies.values()))
    return scored.select(
        *[F.col(n).alias(c) for c, n in copies.items()], score_ops.PROBABILITY, score_ops.PREDICTION, score_ops.LABEL
    )


EXPLANATION_BACKEND = "feature_importance_fallback"


def bundle_basis(bundle: Bundle, config: RenewalConfig = DEFAULT_CONFIG) -> ExplanationBasis:
    """The fitted model's medians and importances as a basis of explanations."""
    return fit_basis(
        None,
        bundle.metadata.get("feature_importances"),
        config,
        medians=bundle.metadata.get("training_feature_medians", {}),
    )


def explain_accounts(
    bundle: Bundle, accounts: DataFrame, config: RenewalConfig = DEFAULT_CONFIG, keep: tuple[str, ...] = ("account_id",)
) -> DataFrame:
    """One explanation record per row: ``keep...``, the prediction, base_value
    (null: the importance form has none), explanation_backend, top_factors
    (array of {feature, feature_value, shap_value}, largest magnitude first)."""
    keep = tuple(c for c in keep if c in accounts.columns)
    scored = score(bundle, accounts, config, keep)
    return scored.select(
        *keep,
        score_ops.PREDICTION,
        score_ops.PROBABILITY,
        score_ops.LABEL,
        F.lit(None).cast(T.DoubleType()).alias("base_value"),
        F.lit(EXPLANATION_BACKEND).alias("explanation_backend"),
        top_factor_list(bundle_basis(bundle, config), config.top_k).alias("top_factors"),
    )


def evaluate(scored_test: DataFrame, config: RenewalConfig = DEFAULT_CONFIG) -> dict[str, Any]:
    """The original's metric set at threshold 0.5 (a handful of numbers), of a
    scored table that is written once and read by every metric."""
    y, p = config.target, score_ops.PROBABILITY
    positive = (F.col(y) == config.positive_class).cast(T.IntegerType())
    df = stored(
        scored_test.select(positive.alias(y), p, (F.col(p) >= 0.5).cast(T.IntegerType()).alias("_pred05")), "scored_test"
    )
    spark = df.sparkSession
    counts = metric_ops.confusion_counts(df, y, "_pred05").first()
    one = spark.createDataFrame([tuple(counts)], "tn long, fp long, fn long, tp long")
    m = metric_ops.metrics_from_counts(one).first().asDict()
    m |= metric_ops.ranking_metrics(df, y, p).first().asDict()
    m["confusion_matrix"] = [[counts["tn"], counts["fp"]], [counts["fn"], counts["tp"]]]
    m["classification_report"] = {
        r["label"]: {"precision": r["precision"], "recall": r["recall"], "f1-score": r["f1_score"], "support": r["support"]}
        for r in metric_ops.report_from_counts(one).collect()
    }
    return m


def fit_and_evaluate(
    split_features: DataFrame,
    config: RenewalConfig = DEFAULT_CONFIG,
    n_trials: int | None = None,
    bundle_path: str | None = None,
) -> Bundle:
    """Search (or probe), final fit on train, evaluation on test, bundle."""
    table = materialized_training_table(split_features.where(F.col("split") == "train"), config)
    test = split_features.where(F.col("split") == "test")
    result = search(table, config, n_trials)
    pipeline, gbt = build_pipeline(config)
    model = pipeline.fit(table, params=param_map(gbt, result.best_params, config.random_state))
    bundle = make_bundle(model, table, config, result.best_params, {})
    metrics = evaluate(score(bundle, test, config, keep=(config.id_column, config.target)), config)
    metrics["best_cv_score"] = result.best_score
    metrics["n_trials"] = n_trials or config.n_trials
    bundle.metrics = metrics
    if bundle_path:
        save_bundle(bundle, bundle_path)
    return bundle


# -- registered model queries (rows-only: a boosted tree has no SQL form) --------------


def default_bundle(spark: SparkSession, sf_dir: str) -> tuple[Bundle, DataFrame]:
    """The default-parameter model of the train split, and the whole split."""
    from .catalog import split_features as splits

    cfg = DEFAULT_CONFIG
    split = splits(spark, sf_dir)
    table = materialized_training_table(split.where(F.col("split") == "train"), cfg)
    pipeline, gbt = build_pipeline(cfg)
    model = pipeline.fit(table, params=param_map(gbt, default_params(cfg), cfg.random_state))
    return make_bundle(model, table, cfg, default_params(cfg), {}), split


def q_score_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit the default-parameter model on the train split, score every account."""
    bundle, split = default_bundle(spark, sf_dir)
    return score(bundle, split).select("account_id", score_ops.PROBABILITY, score_ops.PREDICTION, score_ops.LABEL)


def q_score_accounts_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say about ``score_accounts``: accounts scored, and rows
    that break a rule of its columns."""
    scored = q_score_accounts(spark, sf_dir)
    p, label = F.col(score_ops.PROBABILITY), F.col(score_ops.PREDICTION)
    names = F.when(label == 1, "renewed").otherwise("not_renewed")
    return scored.agg(
        F.count(F.lit(1)).alias("accounts"),
        F.count_distinct("account_id").alias("distinct_accounts"),
        F.count_if((p < 0) | (p > 1) | p.isNull()).alias("bad_probabilities"),
        F.count_if((p >= DEFAULT_CONFIG.prediction_threshold) != (label == 1)).alias("bad_predictions"),
        F.count_if(F.col(score_ops.LABEL) != names).alias("bad_labels"),
    )


def q_explained_accounts_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say about the explanations of the fitted model: records,
    factors, and rows whose factors are not in order of magnitude."""
    bundle, split = default_bundle(spark, sf_dir)
    done = explain_accounts(bundle, split)
    size = F.transform("top_factors", lambda f: -F.abs(f["shap_value"]))
    return done.agg(
        F.count(F.lit(1)).alias("accounts"),
        F.sum(F.size("top_factors")).cast("long").alias("factors"),
        F.count_if(F.array_sort(size) != size).alias("out_of_order"),
        F.count("base_value").alias("base_values"),
    )


#: Logins, days since the last one, label: planted rows that two trees of two
#: levels reproduce (renewed: more than 5 logins, the last at most 10 days ago).
PLANTED_ROWS = ((0.0, 0.0, 0), (0.0, 20.0, 0), (10.0, 0.0, 1), (10.0, 20.0, 0))
PLANTED_STEP = 0.1


def q_fixed_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every account, scored by a model whose rules are known: the classifier
    fitted to ``PLANTED_ROWS``, two trees."""
    from .catalog import features as account_rows

    cfg = DEFAULT_CONFIG
    names = ("login_frequency", "last_login_days", cfg.target)
    planted = spark.createDataFrame([(i, *row) for i, row in enumerate(PLANTED_ROWS)], f"account_id long, {names[0]} double, {names[1]} double, {names[2]} int")
    others = [F.lit(0.0).alias(c) for c in cfg.model_features if c not in names]
    pipeline, gbt = build_pipeline(cfg)
    exact = {gbt.maxIter: 2, gbt.stepSize: PLANTED_STEP, gbt.maxDepth: 2, gbt.subsamplingRate: 1.0, gbt.featureSubsetStrategy: "all"}
    model = pipeline.fit(laid_out(training_table(planted.select("*", *others), cfg), cfg), params=exact)
    scored = score(Bundle(model, {}), account_rows(spark, sf_dir))
    return scored.select("account_id", q6(score_ops.PROBABILITY).alias(score_ops.PROBABILITY), score_ops.PREDICTION, score_ops.LABEL)


def searched(spark: SparkSession, sf_dir: str) -> SearchResult:
    """The configured random search on the train split."""
    from .catalog import split_features as splits

    split = splits(spark, sf_dir)
    return search(materialized_training_table(split.where(F.col("split") == "train")))


def q_cv_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random search over the configured space, mean 3-fold CV ROC-AUC per trial."""
    result = searched(spark, sf_dir)
    rows = [
        (i, p["n_estimators"], p["learning_rate"], p["max_depth"], p["min_samples_split"], p["min_samples_leaf"],
         p["subsample"], str(p["max_features"]), s)
        for i, (p, s) in enumerate(zip(result.trials, result.scores))
    ]
    schema = (
        "trial int, n_estimators int, learning_rate double, max_depth int, min_samples_split int, "
        "min_samples_leaf int, subsample double, max_features string, mean_cv_roc_auc double"
    )
    return spark.createDataFrame(rows, schema)


def q_cv_trials_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say about the search: the held-out rows and positives of
    every (trial, fold), and whether its metric is in range."""
    rows = [
        (i, k, n, positives, 0.0 <= value <= 1.0)
        for i, folds in enumerate(searched(spark, sf_dir).folds)
        for k, (n, positives, value) in enumerate(folds)
    ]
    return spark.createDataFrame(rows, "trial int, fold int, held_out_rows long, positives long, in_range boolean")


MODEL_QUERIES = {
    "score_accounts": q_score_accounts,
    "score_accounts_check": q_score_accounts_check,
    "explained_accounts_check": q_explained_accounts_check,
    "fixed_model_scores": q_fixed_model_scores,
    "cv_trials": q_cv_trials,
    "cv_trials_check": q_cv_trials_check,
}
