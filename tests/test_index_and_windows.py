"""Index fit (E1-E5), unit detection (A6), windows (D1-D3), split."""

import datetime as dt

from pyspark.sql import functions as F

from envspark.operators import cleaning, features, index, slices


def d(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_lags_are_row_based_and_skip_null_city(spark):
    rows = [(1, d(0), "A", 10.0), (2, d(1), "A", 20.0), (3, d(4), "A", None), (4, d(8), "A", 40.0),
            (5, d(8), "A", 50.0), (6, d(2), None, 7.0), (7, None, "A", 60.0)]
    df = spark.createDataFrame(rows, "identifiant long, date date, ville string, temp_max double")
    out = features.add_lags_and_trailing(df, lag_vars=["temp_max"])
    got = {r["identifiant"]: (r["temp_max_lag1"], r["temp_max_moy7j"]) for r in out.collect()}
    assert got[1] == (None, None)
    assert got[2] == (10.0, 10.0)
    assert got[3] == (20.0, 15.0)           # previous row, not previous day
    assert got[4] == (None, 15.0)           # missing value skipped in the mean
    assert got[5] == (40.0, (10 + 20 + 40) / 3)   # duplicate date ordered by row key
    assert got[6] == (None, None)           # missing city -> missing
    assert got[7] == (50.0, 30.0)           # missing date sorts last


def test_constant_training_range_gives_half(spark):
    rows = [(2023, 5.0, 1.0), (2023, 5.0, 2.0), (2024, None, 3.0), (2024, 9.0, 4.0)]
    df = spark.createDataFrame(rows, "annee int, vitesse_vent_max double, temp_max double")
    params = index.fit_index(df)
    out = index.apply_index(df, params).collect()
    # wind is constant on train (2023) -> 0.5 everywhere, even the missing row
    for r in out:
        t = (r["temp_max"] - 1.0) / 1.0
        t = min(max(t, 0.0), 1.0)
        assert abs(r["proxy_pm25"] - 100 * (0.25 * 0.5 + 0.15 * t)) < 1e-9


def test_missing_component_makes_index_missing_and_flag_zero(spark):
    rows = [(2023, 1.0, 10.0), (2023, 2.0, None), (2023, 1.5, 20.0), (2024, 3.0, 30.0)]
    df = spark.createDataFrame(rows, "annee int, vitesse_vent_max double, temp_max double")
    out = index.apply_index(df, index.fit_index(df))
    thr = index.fit_threshold(out.where("annee <= cutoff"))
    flagged = out.crossJoin(thr).select("proxy_pm25", index.alert_flag(F.col("proxy_pm25"), F.col("seuil")).alias("f"))
    got = sorted(flagged.collect(), key=lambda r: (r[0] is None, r[0] or 0))
    assert got[-1][0] is None and got[-1][1] == 0


def test_train_only_fit_ignores_test_rows(spark):
    base = [(2023, float(i), float(i)) for i in range(10)]
    a = spark.createDataFrame(base + [(2024, 100.0, 100.0)], "annee int, vitesse_vent_max double, temp_max double")
    b = spark.createDataFrame(base + [(2024, -5.0, 3.0)], "annee int, vitesse_vent_max double, temp_max double")
    pa, pb = index.fit_index(a).first().asDict(), index.fit_index(b).first().asDict()
    assert pa == pb


def test_seconds_to_hours(spark):
    a = spark.createDataFrame([(43200.0,), (40000.0,)], "duree_jour double")
    b = spark.createDataFrame([(12.0,), (11.5,)], "duree_jour double")
    assert [r[0] for r in cleaning.seconds_to_hours(a).collect()] == [12.0, 40000.0 / 3600]
    assert [r[0] for r in cleaning.seconds_to_hours(b).collect()] == [12.0, 11.5]


def test_temporal_split_missing_year(spark):
    df = spark.createDataFrame([(2023,), (2024,), (2025,), (None,)], "annee int")
    got = {r["annee"]: r["split"] for r in slices.temporal_split(df).collect()}
    assert got == {2023: "train", 2024: "train", 2025: "test", None: None}


def test_task_type(spark):
    df = spark.createDataFrame([(0, 1.5), (1, None), (None, 2.0)], "a int, b double")
    assert cleaning.task_type_of(df, "a") == "classification"
    assert cleaning.task_type_of(df, "b") == "regression"


def test_distributed_quantiles_equal_spark_percentile(spark):
    import random
    from envspark.functions.quantiles import exact_quantiles
    rnd = random.Random(11)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, float(rnd.randint(0, 300)) / 7]))
            for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.8, 1.0]
    pct = df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q"))
    a = {r["g"]: tuple(r["q"]) for r in pct.collect()}
    b = {r["g"]: tuple(r[1:]) for r in exact_quantiles(df, "v", probs, by=["g"]).collect()}
    assert a == b and set(a) == {"a", "b", None}
    g1 = exact_quantiles(df, "v", [0.8]).first()[0]
    g2 = df.agg(F.percentile("v", 0.8)).first()[0]
    assert g1 == g2


def test_halo_split_equals_plain_window(spark):
    import random
    rnd = random.Random(5)
    rows = []
    for i in range(600):
        city = rnd.choice(["A", "A", "A", "B", None])
        date = None if rnd.random() < 0.02 else dt.date(2019 + rnd.randint(0, 4), rnd.randint(1, 12), rnd.randint(1, 28))
        rows.append((i, date, city, rnd.choice([None, float(rnd.randint(0, 50))])))
    # a year with a single row forces halos that span several earlier years
    rows.append((999, dt.date(2030, 1, 1), "B", 1.0))
    df = spark.createDataFrame(rows, "identifiant long, date date, ville string, temp_max double")
    a = features.add_lags_and_trailing(df, lag_vars=["temp_max"])
    b = df.withColumns(features.lag_window_columns(features.city_order_window(), ["temp_max"]))
    cols = ["identifiant", "temp_max_lag1", "temp_max_lag7", "temp_max_moy7j"]
    assert sorted(a.select(*cols).collect()) == sorted(b.select(*cols).collect())
