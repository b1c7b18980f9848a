"""JSON sinks and the model folder."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import UTC, datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firelake.sources.files import matching_paths


def api_json(records: DataFrame) -> DataFrame:
    """Each record as one JSON object; absent values are written as null."""
    body = F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"})
    return records.select(body.alias("json"))


def write_api_json(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    """Evaluation values, importances among them as a map, as `{"metrics": {...}}`."""
    nested = metrics.select(F.struct(*metrics.columns).alias("metrics"))
    nested.coalesce(1).write.mode("overwrite").json(path)


def save_model(spark: SparkSession, model: PipelineModel, path: str, metadata: Mapping[str, object]) -> str:
    """Model and metadata side by side; the metadata gets the time of saving."""
    model.write().overwrite().save(f"{path}/model")
    text = json.dumps(dict(metadata) | {"saved_at": datetime.now(UTC).isoformat()})
    row = spark.createDataFrame([(text,)], T.StructType([T.StructField("value", T.StringType())]))
    row.coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return f"{path}/model"


def load_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/metadata").first()[0])


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    if not matching_paths(spark, f"{path}/model/metadata"):
        raise FileNotFoundError(f"no model under {path}; train first")
    return PipelineModel.load(f"{path}/model")
