"""Splits, samples, histogram, payload JSON, densify."""

import datetime as dt
import json

import numpy as np
from pyspark.sql import functions as F

from envspark import sinks
from envspark.operators import forecast as J
from envspark.operators import rollups as G
from envspark.operators import slices as S


def test_validation_split_positional(spark):
    rows = [(c, dt.date(2024, 1, 1) + dt.timedelta(days=i), i) for c in ("A", "B", "C") for i in range(20)]
    df = spark.createDataFrame(rows, "ville string, date date, identifiant long")
    v = S.validation_split(df, 0.85, 5).collect()
    k = int(60 * 0.85)                       # first 51 rows in (city, date) order fit
    val = sorted((r["ville"], r["identifiant"]) for r in v if r["is_validation"])
    assert len(val) == 60 - k and val[0] == ("C", 11)
    none = S.validation_split(df, 0.85, 20).where("is_validation").count()
    assert none == 0                          # 9 validation rows is not more than 20


def test_sample_exact_size(spark):
    df = spark.range(5000).withColumnRenamed("id", "identifiant")
    a = S.sample_n(df, 2000, 42).collect()
    b = S.sample_n(df, 2000, 42).collect()
    assert len(a) == 2000 and a == b
    assert S.sample_n(df.limit(10), 2000).count() == 10


def test_histogram_matches_numpy_counts(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=1000).round(3)
    df = spark.createDataFrame([(float(v),) for v in x], "r double")
    h = {r["bin"]: r["n"] for r in G.histogram(df, "r", 50).collect()}
    counts, _ = np.histogram(x, bins=50)
    assert sum(h.values()) == 1000 and len(h) == 50
    assert sum(abs(h[i] - counts[i]) for i in range(50)) <= 4   # edge rounding only


def test_payload_json_keeps_nulls(spark):
    obs = spark.createDataFrame([("A", "R", dt.date(2024, 1, 1), 40.0, 0), ("B", "R", dt.date(2024, 1, 2), None, 1)],
                                "ville string, region string, date date, proxy_pm25 double, alerte_pollution int")
    fc = spark.createDataFrame([(dt.date(2024, 1, 3), 41.0, None)], "date date, prediction double, niveau string")
    thr = spark.createDataFrame([(55.5549,)], "seuil double")
    payload = json.loads(sinks.payload_json(obs, fc, thr).first()["payload"])
    assert payload["latest_data_date"] == "2024-01-02T00:00:00"
    assert payload["kpis"]["proxy_pm25_mean"] == 40.0 and payload["kpis"]["alert_days_pct"] == 50.0
    assert payload["kpis"]["threshold_alert"] == 55.55 and payload["kpis"]["cities"] == 2
    assert payload["forecast_next_days"] == [{"date": "2024-01-03", "prediction": 41.0, "niveau": None}]
    assert payload["forecast_source"] == "projection_tendance"


def test_densify_interpolates_linearly(spark):
    rows = [("A", dt.date(2024, 1, 1), 0.0), ("A", dt.date(2024, 1, 5), 8.0), ("A", dt.date(2024, 1, 6), 2.0)]
    df = spark.createDataFrame(rows, "ville string, date date, v double")
    got = {r["date"].day: (r["v"], r["interpole"]) for r in J.densify_daily(df, "v").collect()}
    assert got == {1: (0.0, False), 2: (2.0, True), 3: (4.0, True), 4: (6.0, True), 5: (8.0, False), 6: (2.0, False)}


def test_validation_split_of_wide_rows(spark):
    """A million rows, all columns kept: exactly int(0.85 n) fit, whatever the partitions."""
    n = 1_000_000
    df = spark.range(n, numPartitions=13).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 11 == 1, None).otherwise(F.concat(F.lit("c"), F.col("id") % 40)).alias("ville"),
        F.when(F.col("id") % 97 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.xxhash64("id") % 50).cast("int"))).alias("date"),
        F.col("id").alias("identifiant"), *[F.rand(i).alias(f"x{i}") for i in range(12)])
    v = S.validation_split(df)
    got = v.groupBy("is_validation").agg(F.count(F.lit(1)).alias("n"), F.sum("x3")).collect()
    assert {r["is_validation"]: r["n"] for r in got} == {False: int(0.85 * n), True: n - int(0.85 * n)}
    key = F.struct(F.col("ville").isNull(), "ville", F.col("date").isNull(), "date", "identifiant")
    edge = v.agg(F.max(F.when(~F.col("is_validation"), key)) < F.min(F.when(F.col("is_validation"), key))).first()[0]
    assert edge


def test_read_observations_trims_headers_and_coerces(spark):
    import os
    import tempfile
    from pyspark.sql import types as T
    from envspark.sources.observations import read_observations
    d = tempfile.mkdtemp(prefix="envspark-csv-")
    path = os.path.join(d, "obs.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write(" city\xa0, date ,temp_max,Unnamed: 3\n")
        f.write("A,2024-01-02,31.5,x\nB,not a date,hot,y\n")
    schema = T.StructType([T.StructField("city", T.StringType()), T.StructField("date", T.DateType()),
                           T.StructField("temp_max", T.DoubleType())])
    df = read_observations(spark, path, "csv", schema)
    assert df.columns == ["city", "date", "temp_max", "Unnamed: 3"]
    rows = {r["city"]: (r["date"], r["temp_max"]) for r in df.collect()}
    assert rows == {"A": (dt.date(2024, 1, 2), 31.5), "B": (None, None)}
    from envspark.operators.cleaning import drop_columns
    assert "Unnamed: 3" not in drop_columns(df).columns
