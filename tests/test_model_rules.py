"""Early stopping, model choice, artefact override, the linear forecast, the
boundary row of the validation split and slices by tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from envspark.operators import evaluate as L
from envspark.operators import models as M
from envspark.operators import prep, slices
from envspark.plans.prepare import prepared_observations
from envspark.session import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def p(spark):
    return prepared_observations(spark, SF)


def literal_stop(losses, patience):
    """The rule as a loop: (best round, rounds since, stopped) per round and the rounds kept."""
    best, at, rows, kept = float("inf"), 0, [], None
    for i, x in enumerate(losses, 1):
        if x < best:
            best, at = x, i
        stopped = i - at >= patience or (bool(rows) and rows[-1][2])
        if stopped and kept is None:
            kept = at
        rows.append((at, i - at, stopped))
    return rows, at if kept is None else kept


@pytest.mark.parametrize("seed", range(6))
def test_stop_rule_like_a_loop(spark, seed):
    rng = random.Random(seed)
    losses = [round(abs(30 - i) / 10 + rng.random() * rng.choice([0.01, 3]), 2) for i in range(rng.randrange(1, 90))]
    rows, kept = literal_stop(losses, 7)
    got = M.stop_rule(spark.createDataFrame([(i, x) for i, x in enumerate(losses, 1)], "tour int, perte double"), 7).orderBy("tour").collect()
    assert [(r.meilleur_tour, r.sans_gain, r.arrete) for r in got] == rows
    assert [r.garde for r in got] == [i <= kept for i in range(1, len(losses) + 1)]


def test_booster_is_cut_to_its_best_round(spark, p):
    td = M.training_data(p.obs, only=["temp_max", "humidite_moy", "region"])
    res = M.fit_early_stopped(td, patience=3)
    curve = res.curve.orderBy("tour").collect()
    assert len(curve) == 120 and res.rounds == sum(r.garde for r in curve) == literal_stop([r.perte for r in curve], 3)[1]
    booster = res.model.stages[-1]
    assert booster.getNumTrees == res.rounds < 120
    # the loss of the cut model on the validation rows is the curve's value at the kept round
    tr = td.train.select("*", F.col("_m_ville").alias("ville"), F.col("_m_date").alias("date"), F.col("_m_identifiant").alias("identifiant"))
    held = res.model.transform(slices.validation_split(tr).where("is_validation"))
    loss = held.agg(F.avg((F.col("label") - F.col("prediction")) ** 2)).first()[0]
    assert loss == pytest.approx(curve[res.rounds - 1].perte, rel=1e-6)
    assert res.predictions.count() == td.test.count()


def test_no_validation_rows_no_stopping(spark, p):
    td = M.training_data(p.obs, only=["temp_max"])
    td.train = td.train.limit(60)
    res = M.fit_early_stopped(td)
    assert res.curve.count() == 0 and res.model.stages[-1].getNumTrees == 120 == res.rounds


def test_best_result_first_of_equals(spark):
    rows = [(2, "b", 1.0, 0.5, 1.0, 1.0), (1, "a", 1.0, None, 1.0, 1.0), (4, "d", 1.0, 0.7, 1.0, 1.0), (3, "c", 1.0, 0.7, 1.0, 1.0), (0, "z", 1.0, 0.0, 1.0, 1.0)]
    schema = "ordre int, modele string, temps_secondes double, R2 double, RMSE double, MAE double"
    res = spark.createDataFrame(rows, schema)
    assert tuple(L.best_result(res, "R2").first()) == (3, "c", 0.7)
    table = L.comparison_table(res, "regression").collect()
    assert [r.modele for r in table if r.meilleur] == ["c"] and [r.modele for r in table] == ["c", "d", "b", "z", "a"]
    zero = spark.createDataFrame(rows[1:2] + rows[4:], schema)
    assert L.best_result(zero, "R2").first()["modele"] == "z"                 # 0.0 is a metric
    none = spark.createDataFrame(rows[1:2], schema)
    assert L.best_result(none, "R2").first()["modele"] is None and not L.comparison_table(none, "regression").first()["meilleur"]


def test_training_partitions_by_bytes():
    assert M.training_partitions(100, 40, 8) == 1
    assert M.training_partitions(55_000, 40, 8) == 8
    assert M.training_partitions(55_000, 40, 1000) == 11
    big = M.training_partitions(10 ** 12, 40, 1000)
    assert 100 << 20 <= 10 ** 12 * (8 * 40 + 64) / big <= 128 << 20


def test_linear_expression_equals_the_pipeline(spark, p):
    td = M.training_data(p.obs, only=["temp_max", "humidite_moy", "region", "categorie_meteo"])
    ridge = M.train_candidates(td, ["Ridge"])[0]
    raw = p.obs.where("annee > _cutoff AND proxy_pm25 IS NOT NULL").select("identifiant", F.expr(M.linear_sql(ridge, td)).alias("a"))
    both = raw.join(ridge.predictions.select(F.col("_m_identifiant").alias("identifiant"), "prediction"), "identifiant")
    assert both.count() == raw.count() > 50
    assert both.agg(F.max(F.abs(F.col("a") - F.col("prediction")))).first()[0] < 1e-9
    strange = spark.createDataFrame([(None, None, "unseen", None)], "temp_max double, humidite_moy double, region string, categorie_meteo string")
    expected = M.score(ridge.model, prep.scale(prep.encode_for_model(strange, td.features, td.num_cols, td.cat_cols, td.medians, td.dictionary),
                                               td.scaler, td.features), "regression").first()["prediction"]
    assert strange.select(F.expr(M.linear_sql(ridge, td))).first()[0] == pytest.approx(expected, abs=1e-9)


def test_descriptor_round_trip_and_override(spark, p, tmp_path):
    meta = {"model_name": "m", "task_type": "classification", "target": "alerte_pollution", "feature_cols": ["é"], "num_cols": [], "cat_cols": [],
            "scaler_required": True, "threshold_alert": 12.5, "test_years": 2}
    M.save_descriptor(spark, str(tmp_path), meta)
    d = M.read_descriptor(spark, str(tmp_path))
    assert d.first().asDict() == meta
    out = M.apply_descriptor(p.obs, d, "alerte_pollution", "classification")
    assert out.columns == p.obs.columns
    bad = out.where((F.col("alerte_pollution") != F.coalesce((F.col("proxy_pm25") >= 12.5).cast("int"), F.lit(0)))
                    | (F.col("niveau_alerte") != F.when(F.col("alerte_pollution") == 1, "Alerte").otherwise("Pas d'alerte")))
    assert bad.count() == 0
    M.save_descriptor(spark, str(tmp_path), {**meta, "threshold_alert": None})
    same = M.apply_descriptor(p.obs, M.read_descriptor(spark, str(tmp_path)), "proxy_pm25", "regression")
    assert same.select("identifiant", "alerte_pollution").exceptAll(p.obs.select("identifiant", "alerte_pollution")).count() == 0


def test_boundary_inside_a_hot_cell(spark):
    """One city: a third of all rows on one day, with missing, repeated and very large keys."""
    rng = random.Random(2)
    keys = [None] * 40 + [7] * 50 + [(1 << 62) + i for i in range(60)] + list(range(150))
    rng.shuffle(keys)
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), i) for i in range(100)] + [("B", dt.date(2024, 5, 5), k) for k in keys] \
        + [("B", None, i) for i in range(30)] + [(None, None, i) for i in range(20)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "ville string, date date, identifiant long").repartition(5)
    n = len(rows)
    for fraction in (0.25, 0.5, 0.6, 0.75, 0.86):
        k = int(n * fraction)
        got = slices.validation_split(df, fraction, 5)
        assert got.columns == ["ville", "date", "identifiant", "is_validation"]
        got = got.collect()
        assert len(got) == n and sum(not r.is_validation for r in got) == k

        def place(r):
            return (r[0] is None, r[0] or "", r[1] is None, r[1] or dt.date(1, 1, 1), r[2] is None, r[2] or 0)
        want = sorted(map(place, rows))
        assert sorted(place(r) for r in got if not r.is_validation) == want[:k]


def test_slice_by_tables_prunes_partitions(spark, p):
    from envspark.plans.registry import QUERIES
    years = materialize(spark.createDataFrame([(1996, 5), (1998, 9), (1997, 1)], "y int, n int"), "some-years").where("n > 3").select("y")
    regions = p.obs.select("region").where("region IS NOT NULL").distinct().orderBy("region").limit(2)
    out = slices.slice_observations(p.obs, regions, 1900, 2100, None, years)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and "LeftSemi" in plan
    names = [r[0] for r in regions.collect()]
    want = p.obs.where(F.col("annee").isin(1996, 1998) & F.col("region").isin(names))
    assert out.count() == want.count() > 0 and out.exceptAll(want.select(*out.columns)).count() == 0
    assert "dynamicpruning" in QUERIES["slice_by_tables"](spark, SF)._jdf.queryExecution().executedPlan().toString().lower()
