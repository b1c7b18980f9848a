"""Feature matrix, split, weights, scoring, quality, and the trained model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firelake.checks.query import Query, over
from firelake.checks.rows import FEATURE_LIST, JOIN_CONDITIONS, ORDER, SIDE
from firelake.checks.views import view, with_views
from firelake.operators import evaluation
from firelake.plans.features import ALIKE, feature_matrix
from firelake.plans.scoring import feature_importances, predict, score
from firelake.plans.training import Trained, run_training, train
from firelake.session import work_dir
from firelake.sources.sinks import load_model
from firelake.sources.tables import spread, staged

FIRST_CONDITIONS = {
    "w": "SELECT round(latitude * 1e2) AS la, round(longitude * 1e2) AS lo, wind_speed_kmh, humidity_pct, temp_c,"
    " row_number() OVER (PARTITION BY round(latitude * 1e2), round(longitude * 1e2) ORDER BY fetched_at, seq)"
    " AS rn FROM weather_observations",
    "e": "SELECT round(latitude * 1e2) AS la, round(longitude * 1e2) AS lo, soil_moisture, vpd_kpa, et0_mm,"
    " row_number() OVER (PARTITION BY round(latitude * 1e2), round(longitude * 1e2) ORDER BY fetched_at, seq)"
    " AS rn FROM environmental_conditions",
}
BUCKET = "CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 100"
CONFUSION = (
    "SELECT count(*) FILTER (WHERE score > 0.5e0 AND label = 1) AS tp, count(*) FILTER (WHERE score > 0.5e0 AND label = 0)"
    " AS fp, count(*) FILTER (WHERE score <= 0.5e0 AND label = 1) AS fn, count(*) FILTER (WHERE score <= 0.5e0 AND"
    " label = 0) AS tn FROM scored"
)
RANKED = (
    "SELECT pos, neg, sum(pos) OVER (ORDER BY score DESC) AS cum_pos, sum(neg) OVER (ORDER BY score DESC) AS cum_neg,"
    " sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg FROM (SELECT score, sum(label) AS pos, sum(1 - label) AS neg"
    " FROM scored GROUP BY score) AS g"
)


def matrix(fires: DataFrame, weather: DataFrame, soil: DataFrame) -> DataFrame:
    return feature_matrix(fires, weather, soil, order=ORDER, carry=("event_id",))


def _tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    made: dict[str, DataFrame] = {}
    return [view(spark, sf_dir, name, made) for name in ("fires", *SIDE)]


def _run(job, spark: SparkSession, sf_dir: str) -> tuple[str, Trained]:
    artifacts = work_dir(spark, "artifacts")
    settings = {"key": ("event_id",), "order": ORDER}
    return artifacts, job(*_tables(spark, sf_dir), artifacts, **settings)


def _scored_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(train, spark, sf_dir)[1].scored_test.select("label", "risk")


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every detection scored by the model that was stored."""
    artifacts, _ = _run(train, spark, sf_dir)
    return score(spread(matrix(*_tables(spark, sf_dir)), alike=ALIKE), load_model(spark, artifacts)).select("event_id", "label", "risk")


def _predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _tables(spark, sf_dir)
    model = _run(train, spark, sf_dir)[1].model
    return predict(*tables, model, order=ORDER, tie_break=("event_id",))


def _importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_importances(spark, _run(train, spark, sf_dir)[1].model)


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.json(f"{_run(run_training, spark, sf_dir)[0]}/metrics").select("metrics.*")


def _properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for any forest: sizes of the split, and that stored, measured and ranked values agree."""
    tables = _tables(spark, sf_dir)
    artifacts, fitted = _run(run_training, spark, sf_dir)
    metrics = spark.read.json(f"{artifacts}/metrics").select("metrics.*").first()
    again = load_model(spark, artifacts)
    scored = fitted.scored_test
    measured = evaluation.confusion_metrics(scored, "risk", "label").first()
    ranked = feature_importances(spark, again).collect()
    # Both models score a row in one pass, so every row is joined and dealt once for the two.
    once = score(spread(matrix(*tables), alike=ALIKE), again).withColumnRenamed("risk", "risk_again")
    every = staged(score(once, fitted.model).select("event_id", F.col("risk_again").alias("risk"), F.col("risk").alias("risk_fitted")), "every")
    top = predict(*tables, again, order=ORDER, tie_break=("event_id",)).select("event_id", "pred_score").collect()
    unlisted = every.where(~F.col("event_id").isin([r["event_id"] for r in top])).agg(F.max("risk")).first()[0]
    same_scores = every.where(~F.col("risk").eqNullSafe(F.col("risk_fitted"))).isEmpty()
    row = {
        "n_rows": metrics["n_rows"],
        "n_test_0": scored.where("label = 0").count(),
        "n_test_1": scored.where("label = 1").count(),
        "n_features": len(ranked),
        "metrics_agree": all(metrics[m] == measured[m] for m in ("accuracy", "precision", "recall", "f1")),
        "stored_model_scores_alike": same_scores and again.stages[-1].getNumTrees == fitted.model.stages[-1].getNumTrees,
        "importances_total": round(sum(r["importance"] for r in ranked), 2),
        "importances_fall": [r["importance"] for r in ranked] == sorted((r["importance"] for r in ranked), reverse=True),
        "scores_in_range": every.where("risk BETWEEN 0 AND 1").count() == every.count(),
        "nothing_unlisted_is_higher": unlisted is None or unlisted <= min(r["pred_score"] for r in top),
    }
    return spark.createDataFrame([tuple(row.values())], list(row))


def _report_sql() -> str:
    def ratio(top: str, bottom: str) -> str:
        return f"CASE WHEN {bottom} = 0 THEN 0e0 ELSE ({top}) / CAST({bottom} AS DOUBLE) END"

    def line(name: str, *values: str) -> str:
        rounded = ", ".join(f"round(({v}) * 1e4) / 1e4 AS {c}" for c, v in zip(("precision", "recall", "f1"), values))
        return f"SELECT '{name}' AS class, {rounded}, {values[3]} AS support FROM m"

    measures = (
        f"SELECT {ratio('tn', '(tn + fn)')} AS p0, {ratio('tn', '(tn + fp)')} AS r0,"
        f" {ratio('2 * tn', '(2 * tn + fn + fp)')} AS f0, tn + fp AS s0, {ratio('tp', '(tp + fp)')} AS p1,"
        f" {ratio('tp', '(tp + fn)')} AS r1, {ratio('2 * tp', '(2 * tp + fp + fn)')} AS f1, tp + fn AS s1,"
        f" {ratio('tp + tn', '(tp + fp + fn + tn)')} AS acc, tp + fp + fn + tn AS n FROM c"
    )
    weighted = [f"({m}0 * s0 + {m}1 * s1) / CAST(n AS DOUBLE)" for m in "prf"]
    lines = [
        line("0", "p0", "r0", "f0", "s0"),
        line("1", "p1", "r1", "f1", "s1"),
        line("accuracy", "acc", "acc", "acc", "n"),
        line("macro avg", *[f"({m}0 + {m}1) / 2" for m in "prf"], "n"),
        line("weighted avg", *weighted, "n"),
    ]
    return with_views("\nUNION ALL ".join(lines), "scored", c=CONFUSION, m=measures)


def queries() -> dict[str, Query]:
    tables = ("fires", *SIDE)
    confusion = (
        "SELECT tp, fp, fn, tn, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) * 1e4) / 1e4 AS accuracy,"
        " round(tp / CAST(tp + fp AS DOUBLE) * 1e4) / 1e4 AS precision, round(tp / CAST(tp + fn AS DOUBLE) * 1e4) / 1e4"
        " AS recall, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) * 1e4) / 1e4 AS f1 FROM c"
    )
    return {
        "feature_matrix": Query(
            over(*tables, build=matrix),
            with_views(
                f"SELECT event_id, {FEATURE_LIST}, CASE WHEN lower(trim(f.confidence)) IN ('h', 'high') THEN 1 ELSE 0 END"
                f" AS label FROM fires f {JOIN_CONDITIONS}",
                *tables,
                **FIRST_CONDITIONS,
            ),
        ),
        "stratified_split": Query(
            over(
                "scored",
                build=lambda scored: evaluation.stratified_split(scored.select("event_id", "label"), ("event_id",)),
            ),
            with_views(f"SELECT event_id, label, {BUCKET} < 20 AS is_test FROM scored", "scored"),
        ),
        "exact_split": Query(
            over("scored", build=lambda scored: evaluation.exact_split(scored.select("event_id", "label"), ("event_id",))),
            with_views(
                "SELECT event_id, label, row_number() OVER (PARTITION BY label ORDER BY draw) <= (count(*) OVER (PARTITION BY label)"
                " * 20 + 50) // 100 AS is_test FROM drawn",
                "scored",
                drawn="SELECT event_id, label, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 15) AS BIGINT) AS draw FROM scored",
            ),
        ),
        "model_properties": Query(
            _properties,
            with_views(
                "SELECT count(*) AS n_rows, (count(*) FILTER (WHERE label = 0) * 20 + 50) // 100 AS n_test_0,"
                " (count(*) FILTER (WHERE label = 1) * 20 + 50) // 100 AS n_test_1, 13 AS n_features, TRUE AS metrics_agree,"
                " TRUE AS stored_model_scores_alike, 1e0 AS importances_total, TRUE AS importances_fall, TRUE AS scores_in_range,"
                " TRUE AS nothing_unlisted_is_higher FROM scored",
                "scored",
            ),
        ),
        "class_weights": Query(
            over("scored", build=evaluation.class_weights),
            with_views(
                "SELECT label, count(*) AS n, round((SELECT count(*) FROM scored) / (2e0 * count(*)) * 1e6) / 1e6 AS weight"
                " FROM scored GROUP BY label",
                "scored",
            ),
        ),
        "score_fallback": Query(
            over("fires", build=lambda fires: score(fires).select("event_id", "risk")),
            with_views("SELECT event_id, score AS risk FROM scored", "scored"),
        ),
        "roc_auc": Query(
            over("scored", build=evaluation.roc_auc),
            with_views(
                "SELECT round(sum(neg * (cum_pos - pos / 2e0)) / (max(all_pos) * max(all_neg)) * 1e6) / 1e6 AS roc_auc"
                " FROM ranked",
                "scored",
                ranked=RANKED,
            ),
        ),
        "average_precision": Query(
            over("scored", build=evaluation.average_precision),
            with_views(
                "SELECT round(sum(pos * cum_pos / CAST(cum_pos + cum_neg AS DOUBLE)) / max(all_pos) * 1e6) / 1e6"
                " AS average_precision FROM ranked",
                "scored",
                ranked=RANKED,
            ),
        ),
        "confusion_metrics": Query(
            over("scored", build=evaluation.confusion_metrics), with_views(confusion, "scored", c=CONFUSION)
        ),
        "classification_report": Query(over("scored", build=evaluation.classification_report), _report_sql()),
        # A trained forest has no SQL form: rows only.
        "fit_forest_score": Query(_scored_test),
        "save_load_model": Query(_saved),
        "predict_top": Query(_predict),
        "rank_importances": Query(_importances),
        "write_metrics_json": Query(_metrics),
    }
