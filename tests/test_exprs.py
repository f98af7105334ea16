"""Micro tables for the scalar traps (FIXTURES.md section 3)."""

import datetime as dt

from pyspark.sql import functions as F

from envspark import config as C
from envspark.functions import exprs as X


def col(spark, values, t="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {t}")


def test_bands_right_closed(spark):
    vals = [-0.0005, 0.0, 30.0, 30.0001, 50.0, 70.0, 100.0, 100.1, None]
    got = [r[0] for r in col(spark, vals).select(X.band_ordinal(F.col("x"))).collect()]
    assert got == [None, 1, 1, 2, 2, 3, 4, None, None]
    lab = [r[0] for r in col(spark, vals).select(X.band_label(F.col("x"), C.PROXY_BAND_LABELS)).collect()]
    assert lab[1] == "Bon" and lab[3] == "Modéré" and lab[6] == "Dangereux" and lab[-1] is None


def test_wind_sectors(spark):
    vals = [0.0, 22.5, 22.6, 359.9, -10.0, 360.0, 720.5]
    got = [r[0] for r in col(spark, vals).select(X.wind_sector(F.col("x"))).collect()]
    assert got == ["N", "N", "NNE", "NNO", "NNO", "N", "N"]


def test_wind_regimes(spark):
    rows = [(315.0, 1), (90.0, 3), (91.0, 3), (135.0, 5), (270.0, 10), (271.0, 10), (45.0, 4)]
    df = spark.createDataFrame(rows, "d double, m int")
    got = [r[0] for r in df.select(X.wind_regime(F.col("d"), F.col("m"))).collect()]
    H, M, A = C.REGIME_HARMATTAN, C.REGIME_MOUSSON, C.REGIME_OTHER
    assert got == [H, H, A, M, M, A, A]


def test_numpy_rounding(spark):
    got = [r[0] for r in col(spark, [0.25, 0.35, 2.675, 0.05, 0.15]).select(X.np_round(F.col("x"), 1)).collect()]
    # pandas/numpy rounding (scale, half-even, unscale), not Python's round()
    assert got == [0.2, 0.4, 2.7, 0.0, 0.2]
    import numpy as np
    assert got == [float(np.round(v, 1)) for v in [0.25, 0.35, 2.675, 0.05, 0.15]]


def test_clip_keeps_null(spark):
    got = [r[0] for r in col(spark, [None, -1.0, 0.5, 2.0]).select(X.clip01(F.col("x"))).collect()]
    assert got == [None, 0.0, 0.5, 1.0]


def test_bound_rules():
    assert X.bound_rule("humidite_sol_0_7cm") == "percent"
    assert X.bound_rule("direction_vent_10m_moy") == "angle"
    assert X.bound_rule("vitesse_vent_max") == "nonneg"
    assert X.bound_rule("temp_max") == "none"


def test_month_label(spark):
    got = [r[0] for r in col(spark, [1, 8, 13], "int").select(X.month_label(F.col("x"))).collect()]
    assert got == ["Jan", "Aoû", "13"]


def test_safe_corr_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None)], "a double, b double")
    assert df.select(X.safe_corr(F.col("a"), F.col("b"))).first()[0] is None
    df2 = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (None, 1.0)], "a double, b double")
    assert abs(df2.select(X.safe_corr(F.col("a"), F.col("b"))).first()[0] - 1.0) < 1e-12


def test_parse_helpers(spark):
    df = spark.createDataFrame([("2020-01-05", "3.5"), ("bad", "x"), (None, None)], "d string, v string")
    got = df.select(X.parse_date("d"), X.to_number("v")).collect()
    assert got[0][0] == dt.date(2020, 1, 5) and got[0][1] == 3.5
    assert got[1][0] is None and got[1][1] is None


def test_python_round_exact(spark):
    vals = [55.555, 2.675, 0.125, 0.375, 1.005, 2.5, -0.125, 1234.5678, 0.285, None]
    got = [r[0] for r in col(spark, vals).select(X.py_round(F.col("x"), 2)).collect()]
    assert got == [None if v is None else round(v, 2) for v in vals]
    import random
    rnd = random.Random(3)
    many = [rnd.randint(0, 10 ** 6) / 1000 for _ in range(2000)] + [k / 8 for k in range(-400, 400)]
    got = [r[0] for r in col(spark, many).select(X.py_round(F.col("x"), 2)).collect()]
    assert got == [round(v, 2) for v in many]
