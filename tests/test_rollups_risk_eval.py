"""Rollups, risk, evaluation and preparation traps."""

import datetime as dt

from pyspark.sql import functions as F

from envspark import config as C
from envspark.operators import evaluate as L
from envspark.operators import prep as K
from envspark.operators import risk as R
from envspark.operators import rollups as G


def test_mode_ties_take_first_level(spark):
    rows = [(10.0,), (20.0,), (40.0,), (45.0,)]   # two "Bon", two "Modéré"
    df = spark.createDataFrame([(r[0], 0, "A", "R", 30.0, 5.0, dt.date(2024, 1, i + 1), i) for i, r in enumerate(rows)],
                               "proxy_pm25 double, alerte_pollution int, ville string, region string, "
                               "temp_max double, vitesse_vent_max double, date date, identifiant long")
    df = df.withColumn("latitude", F.lit(1.0)).withColumn("longitude", F.lit(2.0))
    assert G.kpis(df).first()["niveau_mode"] == "Bon"


def test_level_counts_keep_zero_levels(spark):
    df = spark.createDataFrame([("Bon",), ("Bon",), ("Mauvais",), (None,)], "niveau_alerte string")
    got = {r["Niveau"]: r["Jours"] for r in G.level_counts(df).collect()}
    assert got == {"Bon": 2, "Modéré": 0, "Mauvais": 1, "Dangereux": 0}


def test_region_score_30_is_green_with_reinforced_message(spark):
    # 0.65 * 30 + 0.35 * 30 = 30 (alert share 30 %)
    rows = [("R", 30.0, 1 if i < 3 else 0) for i in range(10)]
    df = spark.createDataFrame(rows, "region string, proxy_pm25 double, alerte_pollution int")
    r = R.region_alerts(df).first()
    assert r["score_sanitaire"] == 30.0 and r["niveau"] == "Vert"
    assert r["message"] == C.REGION_MESSAGES[2][1]


def test_categories_code_point_order(spark):
    df = spark.createDataFrame([("Z",), ("a",), ("b",), ("É",), (None,)], "c string")
    dic = K.fit_categories(df, ["c"])
    got = {r["value"]: r["code"] for r in dic.collect()}
    assert got == {"Z": 0, "a": 1, "b": 2, "É": 3}
    enc = K.encode(df, dic, ["c"]).collect()
    assert sorted(r["c"] for r in enc) == [-1, 0, 1, 2, 3]


def test_scaler_population_std_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    p = K.fit_scaler(df, ["a", "b"]).first()
    assert p["a__mean"] == 2.0 and p["a__scale"] == 1.0 and p["b__scale"] == 1.0


BIN = [("g1", 1, 1, 0.9), ("g1", 0, 1, 0.8), ("g1", 1, 0, 0.8), ("g1", 0, 0, 0.1), ("g1", 1, 1, 0.7),
       ("g2", 1, 1, 0.5), ("g2", 0, 0, 0.5), ("g2", 1, 0, 0.2), ("g2", 0, 0, 0.3),
       (None, 1, 1, 0.6), (None, 0, 0, 0.4), (None, 1, 1, 0.9), (None, 0, 1, 0.6), (None, 1, 0, 0.1)]


def _brute_auc(rows):
    pos = [s for _, y, _, s in rows if y == 1]
    neg = [s for _, y, _, s in rows if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_binary_metrics_and_auc(spark):
    df = spark.createDataFrame(BIN, "g string, y int, p int, s double")
    m = L.classification_metrics(df, "y", "p").first()
    tp = sum(1 for _, y, p, _ in BIN if y == 1 and p == 1)
    fp = sum(1 for _, y, p, _ in BIN if y == 0 and p == 1)
    fn = sum(1 for _, y, p, _ in BIN if y == 1 and p == 0)
    assert abs(m["Precision"] - tp / (tp + fp)) < 1e-12 and abs(m["Recall"] - tp / (tp + fn)) < 1e-12
    auc = L.roc_auc(df, "y", "s").first()["ROC_AUC"]
    assert abs(auc - _brute_auc(BIN)) < 1e-12
    # groups: g2 has 4 rows -> dropped; the missing key is kept
    grp = L.evaluate_groups(df, "classification", "y", "p", "s", ["g"]).collect()
    assert {r["groupe"] for r in grp} == {"g1", None}
    g1 = [r for r in grp if r["groupe"] == "g1"][0]
    assert abs(g1["ROC_AUC"] - _brute_auc([r for r in BIN if r[0] == "g1"])) < 1e-12


def test_auc_many_buckets_matches_brute_force(spark):
    import random
    rnd = random.Random(7)
    rows = [("x", rnd.randint(0, 1), 0, round(rnd.random(), 2)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, y int, p int, s double")
    auc = L.roc_auc(df, "y", "s").first()["ROC_AUC"]
    assert abs(auc - _brute_auc(rows)) < 1e-12
    pts = {r["seuil"]: (r["tpr"], r["fpr"]) for r in L.roc_points(df, "y", "s").collect()}
    P = sum(1 for r in rows if r[1] == 1)
    t = 0.5
    assert abs(pts[t][0] - sum(1 for r in rows if r[1] == 1 and r[3] >= t) / P) < 1e-12


def test_all_one_class(spark):
    df = spark.createDataFrame([(1, 0, 0.2), (1, 0, 0.4)], "y int, p int, s double")
    assert L.roc_auc(df, "y", "s").first()["ROC_AUC"] is None
    m = L.classification_metrics(df, "y", "p").first()
    assert m["Precision"] == 0.0 and m["F1"] == 0.0


def test_constant_target_r2(spark):
    a = spark.createDataFrame([(5.0, 5.0), (5.0, 5.0)], "y double, p double")
    b = spark.createDataFrame([(5.0, 4.0), (5.0, 5.0)], "y double, p double")
    assert L.regression_metrics(a, "y", "p").first()["R2"] == 1.0
    assert L.regression_metrics(b, "y", "p").first()["R2"] == 0.0


def test_city_risk_trend_rule(spark):
    # city A: 10 days rising by 1 -> last 7 mean minus older 3 mean; city B: 5 days -> 0
    rows = [("A", dt.date(2024, 1, i + 1), float(i)) for i in range(10)] + \
           [("B", dt.date(2024, 1, i + 1), 50.0) for i in range(5)]
    df = spark.createDataFrame(rows, "ville string, date date, proxy_pm25 double")
    got = {r["ville"]: r["tendance_7j"] for r in R.recent_delta(R.daily_city_mean(df)).collect()}
    assert got["A"] == sum(range(3, 10)) / 7 - sum(range(0, 3)) / 3 and got["B"] == 0.0
