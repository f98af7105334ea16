"""Streaming application of the fitted index (stateless) and of the daily
city mean (stateful with a watermark)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark import config as C
from envspark.functions.exprs import level_expr
from envspark.operators import features, index
from envspark.plans.prepare import clean_observations


def score_stream(stream: DataFrame, params: DataFrame) -> DataFrame:
    """E2/E4/F1 on new observation rows (source column names).

    ``params`` is the one-row table fitted by the batch run (index bounds and
    ``seuil``): the bounds stay the training ones, as in the batch index.
    Lag features need per-city history and are left to the batch plan."""
    df = clean_observations(stream)
    df = features.with_calendar(df)
    df = features.add_derived(df)
    j = df.crossJoin(F.broadcast(params))
    cols = df.columns
    out = j.withColumn("proxy_pm25", index.proxy_expr(cols))
    st = index.stagnation_expr(cols)
    if st is not None:
        out = out.withColumn("indice_stagnation", st)
    out = out.withColumn("score_risque", F.col("proxy_pm25"))
    out = out.withColumn("alerte_pollution", index.alert_flag(F.col("proxy_pm25"), F.col("seuil")))
    out = out.withColumn("niveau_alerte", level_expr(F.col("proxy_pm25"), C.target_config("proxy_pm25")))
    keep = cols + [c for c in ("proxy_pm25", "indice_stagnation", "score_risque", "alerte_pollution",
                               "niveau_alerte") if c in out.columns]
    return out.select(*keep)


def daily_city_mean_stream(scored: DataFrame, target: str = "proxy_pm25", late_days: int = 7) -> DataFrame:
    """D5 on a stream: mean target and alert days per (city, day), rows up to
    ``late_days`` late are merged, older state is evicted by the watermark."""
    ts = F.col("date").cast("timestamp")
    return (scored.where(F.col("date").isNotNull() & F.col("ville").isNotNull())
                  .withColumn("_ts", ts)
                  .withWatermark("_ts", f"{int(late_days)} days")
                  .groupBy("ville", F.window("_ts", "1 day").alias("jour"))
                  .agg(F.avg(target).alias(target), F.sum("alerte_pollution").alias("jours_alerte"),
                       F.count(F.lit(1)).alias("n")))
