"""Train the risk model and measure it on held-out rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firelake.operators.evaluation import (
    average_precision,
    classification_report,
    confusion_metrics,
    exact_split,
    roc_auc,
    with_class_weight,
)
from firelake.plans.features import ALIKE, feature_matrix
from firelake.plans.scoring import feature_importances, score
from firelake.schemas import DETECTION_KEY, FEATURES
from firelake.sources.sinks import load_model, save_model, write_metrics_json
from firelake.sources.tables import LEAST_ROWS, spread, staged

SEED = 42
TREES = 100
TEST_PERCENT = 20
MAX_DEPTH = 10
# Quality is measured on finer scores than are handed out.
QUALITY_DIGITS = 6
# Megabytes of node statistics that one pass of a fit over many rows fills: few enough to stay near the core, as like rows follow
# each other, and enough for few passes, each of which reads again whatever the executors' memory does not hold.
GROUP_MB = 32


class Trained(NamedTuple):
    model: PipelineModel
    scored_test: DataFrame
    about: dict[str, object]


def fit_forest(train: DataFrame, trees: int = TREES, max_depth: int = MAX_DEPTH, seed: int = SEED) -> PipelineModel:
    """Random forest over class-weighted rows of features and label.

    A pass over all nodes of a deep level updates, for every row, far more statistics than a core's cache holds. More than
    LEAST_ROWS rows are therefore fitted some trees at a time, in more and shorter passes. The features
    drawn at a node go by the order of the nodes, so shorter tables keep MLlib's own order.
    """
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(
        labelCol="label", weightCol="weight", numTrees=trees, maxDepth=max_depth, seed=seed
    )
    if train.count() > LEAST_ROWS:
        forest.setMaxMemoryInMB(GROUP_MB)
    return Pipeline(stages=[assembler, forest]).fit(with_class_weight(train))


def train(
    fires: DataFrame,
    weather: DataFrame | None,
    soil: DataFrame | None,
    artifacts: str,
    key: Sequence[str] = tuple(DETECTION_KEY),
    order: Sequence[str] = ("fetched_at",),
    trees: int = TREES,
    max_depth: int = MAX_DEPTH,
    test_percent: int = TEST_PERCENT,
) -> Trained:
    """Feature matrix, split, fit; the stored model, and the test rows it scored.

    The matrix is written once; the split, the fit and the test rows read it from there. A row costs
    the fit a hundred trees at every level, however few bytes it has, so the training rows are
    dealt evenly over the cores, not by the files of the matrix, and a core takes like rows one after the
    other, so that the nodes they reach are still near it. They are read a few times and kept for that, spilling to disk, and rebuilt from the tables if an executor is lost. The
    test rows are scored with the model as read back: a fresh one holds its training
    summary, and with it the session, which cannot be sent to executors.
    """
    matrix = staged(feature_matrix(fires, weather, soil, order=order, carry=key), "matrix")
    split = exact_split(matrix, key, test_percent).drop(*key)
    n_rows = matrix.count()
    training = spread(split.where(~F.col("is_test")), n_rows, ALIKE).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        about = {
            "model": "RandomForestClassifier",
            "n_rows": n_rows,
            "n_estimators": trees,
            "test_size": test_percent / 100,
            "features": FEATURES,
        }
        save_model(fires.sparkSession, fit_forest(training, trees, max_depth), artifacts, about)
    finally:
        training.unpersist()
    model = load_model(fires.sparkSession, artifacts)
    return Trained(model, score(spread(split.where("is_test"), n_rows, ALIKE), model, digits=QUALITY_DIGITS), about)


def evaluate(scored: DataFrame, score_column: str = "risk", label: str = "label") -> dict[str, DataFrame]:
    """Every quality measure, each a lazy plan over the scored rows."""
    return {
        "confusion": confusion_metrics(scored, score_column, label),
        "report": classification_report(scored, score_column, label),
        "roc_auc": roc_auc(scored, score_column, label, QUALITY_DIGITS),
        "average_precision": average_precision(scored, score_column, label, QUALITY_DIGITS),
    }


def metrics_row(trained: Trained) -> DataFrame:
    """One row with settings, quality and importances, as written to the metrics file."""
    spark = trained.scored_test.sparkSession
    measures = evaluate(trained.scored_test)
    importances = feature_importances(spark, trained.model).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "importance"))).alias("feature_importances")
    )
    settings = {name: value for name, value in trained.about.items() if name != "features"}
    return measures["confusion"].select(
        *[F.lit(value).alias(name) for name, value in settings.items()],
        F.lit(len(FEATURES)).alias("n_features"),
        "accuracy",
        "precision",
        "recall",
        "f1",
        measures["roc_auc"].scalar().alias("auc_roc"),
        measures["average_precision"].scalar().alias("average_precision"),
        importances.scalar().alias("feature_importances"),
    )


def run_training(
    fires: DataFrame,
    weather: DataFrame | None,
    soil: DataFrame | None,
    artifacts: str,
    **settings: object,
) -> Trained:
    """Train, measure, and leave model, metadata and metrics under `artifacts`.

    The measures pass over the scored test rows several times, and so may the caller: they are
    scored once and stored.
    """
    fitted = train(fires, weather, soil, artifacts, **settings)
    fitted = fitted._replace(scored_test=staged(fitted.scored_test, "scored_test"))
    write_metrics_json(metrics_row(fitted), f"{artifacts}/metrics")
    return fitted
