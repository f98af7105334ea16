"""Training run on the smallest data: ridge only, artefact save/load round
trip (M3) and the model forecast for every eligible city (J4 + J5)."""

import os
import tempfile

from pyspark.sql import functions as F

from envspark.operators import evaluate, forecast, models
from envspark.plans.prepare import prepared_observations

SF = "/root/testdata/sf0.001"


def test_ridge_artefact_roundtrip_and_forecast(spark):
    p = prepared_observations(spark, SF)
    td = models.training_data(p.obs)
    assert td.task == "regression" and "temp_max" not in td.features      # anti-leak exclusion
    res = models.train_candidates(td, ["Ridge"])
    best = models.select_best(res, td.task)
    assert best.name == "Ridge" and best.metrics["RMSE"] > 0
    comp = evaluate.comparison_table(models.results_frame(spark, res, td.task), td.task).collect()
    assert comp[0]["modele"] == "Ridge" and comp[0]["meilleur"]
    path = os.path.join(tempfile.mkdtemp(prefix="envspark-art-"), "model")
    models.save_artefact(path, best, td, 70.0)
    art = models.load_artefact(spark, path)
    assert art.meta["model_name"] == "Ridge" and art.meta["scaler_required"] is True
    # the stored threshold replaces the fitted one, and the flag follows
    over = models.apply_artefact(p.obs, art)
    assert over.where("proxy_pm25 >= 70 AND alerte_pollution <> 1 OR (proxy_pm25 < 70 OR proxy_pm25 IS NULL) AND alerte_pollution <> 0").count() == 0
    assert over.where("alerte_pollution = 1").count() != p.obs.where("alerte_pollution = 1").count()
    # the reloaded model scores the test rows exactly like the fitted one
    a = models.score(best.model, td.test_scaled, td.task).select("prediction").collect()
    b = models.score(art.model, td.test_scaled, td.task).select("prediction").collect()
    assert a == b
    fut = forecast.future_features(p.obs, 3)
    fc = models.forecast_model(fut, art)
    rows = fc.collect()
    n_cities = forecast.eligible_cities(p.obs).count()
    assert len(rows) == 3 * n_cities
    assert all(0.0 <= r["prediction"] <= 100.0 for r in rows)
    assert {r["source_prevision"] for r in rows} == {"Artefact pipeline - Ridge"}
    imp = models.feature_importance(spark, best, td.features).collect()
    assert len(imp) == 20 and imp[0]["importance"] >= imp[-1]["importance"]
