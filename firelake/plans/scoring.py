"""Risk score of each detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firelake.functions import fallback_risk, round_to
from firelake.operators.ordering import top_scored
from firelake.plans.features import ALIKE, feature_columns, feature_matrix
from firelake.schemas import FEATURES
from firelake.sources.sinks import load_model
from firelake.sources.tables import spread


# Length of the printed ranking.
TOP_SHOWN = 20


class ModelUnavailableError(RuntimeError):
    """A model score was asked for and no model can be read."""


def fallback_allowed(model_path: str | None, allow_fallback: bool | None = None) -> bool:
    """An explicit setting decides; without one, naming a model path forbids the fallback."""
    return model_path is None if allow_fallback is None else allow_fallback


def model_or_fallback(
    spark: SparkSession, model_path: str | None, allow_fallback: bool | None = None
) -> PipelineModel | None:
    """The model, or None where the formula may stand in for it."""
    try:
        if model_path is None:
            raise FileNotFoundError("no model path given")
        return load_model(spark, model_path)
    except Exception as error:
        if fallback_allowed(model_path, allow_fallback):
            return None
        raise ModelUnavailableError(str(error)) from error


def score(
    rows: DataFrame, model: PipelineModel | None = None, allow_fallback: bool = True, digits: int = 4
) -> DataFrame:
    """Adds `risk`: the model's probability of class 1 to `digits` places, or the fallback formula."""
    if model is None:
        if not allow_fallback:
            raise ModelUnavailableError("no model and the fallback is off")
        return rows.withColumn("risk", fallback_risk(F.col("bright_ti4"), F.col("frp")))
    # The features go in under their own names, so the row's raw values are set aside.
    kept = F.struct(*rows.columns).alias("_row")
    scored = model.transform(rows.select(kept, *feature_columns()))
    risk = round_to(vector_to_array("probability")[1], digits)
    return scored.select("_row.*", risk.alias("risk"))


def predict(
    fires: DataFrame,
    weather: DataFrame | None,
    soil: DataFrame | None,
    model: PipelineModel,
    k: int = TOP_SHOWN,
    order: Sequence[str] = ("fetched_at",),
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """The k detections of highest model score, with both reading tables as in training."""
    matrix = feature_matrix(fires, weather, soil, order=order, carry=(F.struct(*fires.columns).alias("detection"),))
    scored = score(spread(matrix, alike=ALIKE), model).select("detection.*", F.col("risk").alias("pred_score"))
    return top_scored(scored, k, "pred_score", tie_break)


def feature_importances(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Feature and importance, most important first; one row per model feature."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(name, round(float(value), 4)) for name, value in zip(FEATURES, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
