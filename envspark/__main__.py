"""Command line: run the batch job end to end.

    python -m envspark --data /root/testdata/sf0.01 --out /shared/run-1 [--target proxy_pm25]

Prepares the observation table, trains and compares the candidate models,
exports the comparison / predictions / per-group metrics (CSV), the model
artefact and the run summary (JSON), then writes the dashboard tables (city
risk, regional alerts, recommendations, KPIs, rollups, trend and model
forecasts, API payload) as Parquet / JSON under ``--out``.  On a cluster
``--out`` and ``spark.checkpoint.dir`` must name shared storage.
"""

from __future__ import annotations

import argparse
import os

from envspark import sinks
from envspark.operators import forecast, risk, rollups
from envspark.plans import batch
from envspark.plans.context import prepared
from envspark.session import get_session


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="envspark")
    ap.add_argument("--data", required=True, help="folder with the driver parquet tables")
    ap.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    ap.add_argument("--target", default="proxy_pm25")
    ap.add_argument("--horizon", type=int, default=7)
    ap.add_argument("--master", default=None)
    args = ap.parse_args(argv)

    spark = get_session(args.master, app="envspark-batch")
    p = prepared(spark, args.data)
    run = batch.train_and_compare(p, args.target)
    files = batch.export(run, p, args.out)

    def save(df, name):
        df.write.mode("overwrite").parquet(os.path.join(args.out, "tables", name))

    obs = p.obs
    city = risk.city_risk(obs)
    save(city, "score_risque_ville")
    save(risk.region_alerts(obs), "alertes_regions")
    save(risk.recommendations(obs, city, p.params.select("seuil")), "recommandations")
    save(rollups.kpis(obs), "kpis")
    save(rollups.city_map(obs), "carte_villes")
    save(rollups.monthly_mean(obs), "moyenne_mensuelle")
    save(rollups.month_region_pivot(obs), "mois_region")
    save(rollups.wind_rose_counts(obs), "rose_des_vents")
    save(rollups.regime_stats(obs), "regimes_vent")
    save(rollups.target_correlations(obs), "correlations")
    trend = forecast.forecast_trend(obs, "proxy_pm25", args.horizon)
    save(trend, "prevision_tendance")
    save(batch.model_forecast(p, files["modele"], args.horizon), "prevision_modele")
    first = obs.agg({"ville": "min"}).withColumnRenamed("min(ville)", "ville")
    payload = sinks.payload_json(obs, trend.join(first, "ville", "left_semi"), p.params.select("seuil"))
    payload.coalesce(1).write.mode("overwrite").text(os.path.join(args.out, "api_payload"))
    print(files)


if __name__ == "__main__":
    main()
