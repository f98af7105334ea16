"""Streaming scoring reproduces the batch index on the same rows."""

import os
import tempfile

from pyspark.sql import functions as F

from envspark.plans.prepare import prepare
from envspark.sources.observations import observations_from_orders
from envspark.streaming import daily_city_mean_stream, score_stream

SF = "/root/testdata/sf0.001"


def test_stream_scoring_matches_batch(spark):
    raw = observations_from_orders(spark, SF)
    p = prepare(raw)
    src = tempfile.mkdtemp(prefix="envspark-stream-src-")
    raw.write.mode("overwrite").parquet(os.path.join(src, "in"))
    stream = spark.readStream.schema(raw.schema).parquet(os.path.join(src, "in"))
    scored = score_stream(stream, p.params)
    q = (scored.writeStream.format("memory").queryName("scored_obs").outputMode("append")
         .option("checkpointLocation", os.path.join(src, "ck1")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.table("scored_obs").select("identifiant", "proxy_pm25", "alerte_pollution")
    exp = p.obs.select("identifiant", F.col("proxy_pm25").alias("p2"), F.col("alerte_pollution").alias("a2"))
    j = got.join(exp, "identifiant")
    assert j.count() == p.obs.count()
    bad = j.where(~F.col("proxy_pm25").eqNullSafe(F.col("p2")) | (F.col("alerte_pollution") != F.col("a2")))
    assert bad.count() == 0

    daily = daily_city_mean_stream(score_stream(
        spark.readStream.schema(raw.schema).parquet(os.path.join(src, "in")), p.params))
    q2 = (daily.writeStream.format("memory").queryName("daily_stream").outputMode("append")
          .option("checkpointLocation", os.path.join(src, "ck2")).trigger(availableNow=True).start())
    q2.awaitTermination(300)
    assert spark.table("daily_stream").count() > 0
