"""M. Sinks and payload: CSV export (M1), run summary JSON (M2), API
payload (M4).  Writers go through the DataFrame writer (distributed, one
file set per output folder); nothing is assembled on the driver except the
few scalars of the run summary.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark import config as C
from envspark.functions.exprs import py_round


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """M1: header, no index column.  ``single_file`` only for small reports."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def export_filtered(df: DataFrame, path: str, target: str = "proxy_pm25", level_col: str | None = "niveau_target") -> str:
    """M1: the selected slice with the data browser's columns that exist, all rows."""
    cols = [c for c in C.BROWSER_COLS + [target] + ([level_col] if level_col else []) if c in df.columns]
    return export_csv(df.select(*dict.fromkeys(cols)), path)


def run_summary(spark: SparkSession, target: str, task: str, n_train: int, n_test: int, n_features: int,
                best: str, best_score: float, best_metrics: dict, comparison: DataFrame,
                files: dict, path: str | None = None) -> DataFrame:
    """M2: nested run summary as a one-row DataFrame (struct columns);
    written with ``write.json`` when a path is given."""
    key = "F1" if task == "classification" else "R2"
    head = spark.createDataFrame(
        [(target, task, key, n_train, n_test, n_features, best, float(best_score),
          json.dumps(best_metrics), json.dumps(files))],
        "target string, task_type string, metric_cle string, train_rows long, test_rows long, "
        "n_features long, nom string, score double, metriques string, fichiers_generes string")
    res = comparison.agg(F.collect_list(F.struct(*comparison.columns)).alias("resultats_modeles"))
    out = head.crossJoin(res).select(
        "target", "task_type", "metric_cle", "train_rows", "test_rows", "n_features",
        F.struct("nom", "score", F.from_json("metriques", "map<string,double>").alias("metriques"))
         .alias("meilleur_modele"),
        "resultats_modeles",
        F.from_json("fichiers_generes", "map<string,string>").alias("fichiers_generes"))
    if path:
        out.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return out


def summary_rows(summary: DataFrame) -> DataFrame:
    """M2 unfolded: one row per candidate of a run summary, with the run's
    scalars, the best candidate's metrics and the files beside it."""
    head = ["target", "task_type", "metric_cle", "train_rows", "test_rows", "n_features"]
    best, files = F.col("meilleur_modele"), F.map_keys("fichiers_generes")
    return summary.select(*head, best["nom"].alias("nom"), best["score"].alias("score"),
                          F.array_join(F.array_sort(F.map_keys(best["metriques"])), ",").alias("metriques"),
                          F.array_join(F.array_sort(files), ",").alias("fichiers"),
                          F.explode("resultats_modeles").alias("_r")).select("*", "_r.*").drop("_r")


def payload_rows(df: DataFrame, forecast: DataFrame, threshold: DataFrame, target: str = "proxy_pm25",
                 cfg: C.TargetConfig | None = None) -> DataFrame:
    """M4 as rows: the payload KPIs (Python ``round(x, 2)``) repeated on each forecast
    record (date as yyyy-MM-dd, latest data date as an ISO timestamp).
    ``threshold`` is a one-row table ``seuil``; the forecast may be of one city
    or, with a column ``ville``, of many.  Its source defaults to the trend projection."""
    cfg = cfg or C.target_config(target)
    k = df.agg(
        F.date_format(F.max("date"), "yyyy-MM-dd'T'HH:mm:ss").alias("latest_data_date"),
        py_round(F.avg("proxy_pm25"), 2).alias("proxy_pm25_mean"),
        py_round(F.avg("alerte_pollution") * F.lit(100.0), 2).alias("alert_days_pct"),
        F.count_distinct("ville").alias("cities"),
        F.count_distinct("region").alias("regions"),
        (py_round(F.avg(target), 2) if target in df.columns else F.lit(None).cast("double")).alias("target_mean"),
    ).crossJoin(F.broadcast(threshold.select(py_round(F.col("seuil"), 2).alias("threshold_alert"))))       # one row
    src = "source_prevision" if "source_prevision" in forecast.columns else None
    city = ["ville"] if "ville" in forecast.columns else []
    fc = forecast.select(*city, F.date_format("date", "yyyy-MM-dd").alias("date"), "prediction", "niveau",
                         (F.col(src) if src else F.lit(C.TREND_SOURCE)).alias("forecast_source"))
    return fc.crossJoin(F.broadcast(k)).select(*k.columns, *fc.columns).withColumns({
        "target_name": F.lit(target), "target_label": F.lit(cfg.label), "task_type": F.lit(cfg.task_type)})


def payload_json(df: DataFrame, forecast: DataFrame, threshold: DataFrame, target: str = "proxy_pm25",
                 cfg: C.TargetConfig | None = None) -> DataFrame:
    """M4: the nested payload of one city's forecast as one JSON string (NULL fields kept, T29).
    ``generated_at`` is the run time and is kept out of compared outputs."""
    rows = payload_rows(df, forecast, threshold, target, cfg)
    rec = F.struct("date", "prediction", "niveau")
    agg = rows.groupBy("latest_data_date", "proxy_pm25_mean", "alert_days_pct", "threshold_alert", "cities",
                       "regions", "target_name", "target_label", "task_type", "target_mean").agg(
        F.sort_array(F.collect_list(rec)).alias("forecast_next_days"),
        F.first("forecast_source").alias("forecast_source"))
    payload = agg.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"),
        "latest_data_date",
        F.struct("proxy_pm25_mean", "alert_days_pct", "threshold_alert", "cities", "regions",
                 "target_name", "target_label", "task_type", "target_mean").alias("kpis"),
        "forecast_next_days", "forecast_source")
    return payload.select(F.to_json(F.struct(*payload.columns), {"ignoreNullFields": "false"}).alias("payload"))
