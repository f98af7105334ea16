"""Batch training run: prepared observations -> training data (A7, C3, A13,
K1-K3) -> candidate models (K5-K9, K11) -> comparison (L7) -> best (K12) ->
importance (K13) -> predictions, per-group evaluation (L6, L8) -> exports
(M1-M3) -> model forecast (J4, J5).

Outputs go under ``out_dir``; on a cluster that is a shared folder.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark import sinks
from envspark.operators import evaluate, forecast, models
from envspark.plans.prepare import Prepared


@dataclass
class BatchRun:
    td: models.TrainingData
    results: list
    comparison: DataFrame
    best: models.RunResult
    importance: DataFrame
    predictions: DataFrame
    groups: DataFrame


def train_and_compare(p: Prepared, target: str = "proxy_pm25", names: list[str] | None = None) -> BatchRun:
    spark = p.obs.sparkSession
    td = models.training_data(p.obs, target)
    results = models.train_candidates(td, names)
    comp = evaluate.comparison_table(models.results_frame(spark, results, td.task), td.task)
    best = models.select_best(results, td.task)
    imp = models.feature_importance(spark, best, td.features)
    meta = [F.col(f"_m_{c}").alias(c) for c in td.meta_cols]
    pred = best.predictions.select(*meta, F.col("label").alias(target), "prediction",
                                   *(["score_prediction"] if td.task == "classification" else []))
    groups = evaluate.evaluate_groups(pred, td.task, target, "prediction",
                                      "score_prediction" if td.task == "classification" else None)
    return BatchRun(td, results, comp, best, imp, pred, groups)


def export(run: BatchRun, p: Prepared, out_dir: str) -> dict:
    """M1-M3: comparison / predictions / group CSVs, artefact, run summary."""
    files = {
        "comparaison_modeles": sinks.export_csv(run.comparison, os.path.join(out_dir, "comparaison_modeles"), True),
        "predictions_test": sinks.export_csv(run.predictions, os.path.join(out_dir, "predictions_test")),
        "resultats_groupes": sinks.export_csv(run.groups, os.path.join(out_dir, "resultats_groupes")),
    }
    thr = p.params.select("seuil").first()["seuil"]
    files["modele"] = models.save_artefact(os.path.join(out_dir, "meilleur_modele"), run.best, run.td, thr)
    n = run.td.train.count(), run.td.test.count()
    sinks.run_summary(p.obs.sparkSession, run.td.target, run.td.task, n[0], n[1], len(run.td.features),
                      run.best.name, run.best.metrics.get(models.key_metric(run.td.task)) or 0.0,
                      run.best.metrics, run.comparison, files, os.path.join(out_dir, "resume_metriques"))
    return files


def model_forecast(p: Prepared, artefact_dir: str, horizon: int = 7) -> DataFrame:
    """J4 + J5 for every city from a saved artefact."""
    art = models.load_artefact(p.obs.sparkSession, artefact_dir)
    fut = forecast.future_features(p.obs, horizon)
    return models.forecast_model(fut, art)
