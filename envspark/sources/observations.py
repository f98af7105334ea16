"""Observation sources.

* ``read_observations`` (A1): read a landed observation file (parquet or
  csv with header) with an explicit schema, trimming header names.
* ``observations_from_orders``: the observation adapter that derives the
  canonical (city, day) weather table from the driver's star schema
  (orders, customer, nation, region, lineitem); see FIXTURES.md section 2.
* ``observations_from_events``: dense short daily series from ``events``.

Scale notes for the adapter.  lineitem is the only large input.  It is
first reduced to one row per order with decomposable aggregates (count,
sum, min, max), which Spark computes map-side (partial aggregation) before
the shuffle on ``l_orderkey``; the join with orders then reuses that hash
partitioning.  orders and customer grow with the data and get no hint: the
planner broadcasts them only below ``spark.sql.autoBroadcastJoinThreshold``
(a size check on their statistics, small scale factors) and shuffle-joins
them beyond it, with AQE splitting skewed join partitions; nation and region
are TPC-H dimensions with a fixed size of 25 and 5 rows, so their explicit
broadcast is bounded.  The final group-by on
(nation, day) again aggregates map-side, so a hot nation or a hot day only
produces one partial row per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envspark.sources.tables import read_table

# TPC-H fixes nation at 25 rows and region at 5: a proven broadcast bound.
FIXED_DIMENSION_ROWS = {"nation": 25, "region": 5}


def read_observations(spark: SparkSession, path: str, fmt: str = "parquet",
                      schema: T.StructType | None = None) -> DataFrame:
    """A1: one header row, whole-table scan; header names trimmed and
    nbsp -> space.  With a ``schema`` every present column is coerced to its
    declared type (``try_cast``: unparsable -> NULL, never an error)."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "PERMISSIVE")
    df = reader.load(path)
    clean = [c.replace("\xa0", " ").strip() for c in df.columns]
    if clean != df.columns:
        df = df.toDF(*clean)
    if schema is None:
        return df
    present = [f for f in schema.fields if f.name in df.columns]
    return df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in present],
                     *[c for c in df.columns if c not in schema.fieldNames()])


def _per_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey",
                    "l_linenumber", "l_quantity")
    return li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.max("l_quantity").alias("q_max"),
        F.min("l_quantity").alias("q_min"),
        F.min("l_linenumber").alias("ln_min"),
        F.sum("l_linenumber").alias("ln_sum"),
        F.sum(F.col("l_orderkey") + F.col("l_partkey")).alias("okpk_sum"),
        F.sum("l_suppkey").alias("sk_sum"),
        F.min("l_partkey").alias("pk_min"),
        F.max("l_partkey").alias("pk_max"),
        F.sum("l_partkey").alias("pk_sum"),
    )


def observations_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical observation table (source column names) from the star schema."""
    lines = _per_order_lines(spark, sf_dir)
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    customer = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")

    j = (lines.join(orders, lines.l_orderkey == orders.o_orderkey)
         .join(customer, orders.o_custkey == customer.c_custkey)
         .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
         .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
         .withColumn("day", F.to_date("o_orderdate")))

    g = j.groupBy("n_nationkey", "n_name", "n_regionkey", "r_name", "day").agg(
        F.min("o_orderkey").alias("id"),
        F.sum("n_lines").alias("cnt"),
        F.max("q_max").alias("q_max"),
        F.min("q_min").alias("q_min"),
        F.min("ln_min").alias("ln_min"),
        F.sum("ln_sum").alias("ln_sum"),
        F.sum("okpk_sum").alias("okpk_sum"),
        F.sum("sk_sum").alias("sk_sum"),
        F.min("pk_min").alias("pk_min"),
        F.max("pk_max").alias("pk_max"),
        F.sum("pk_sum").alias("pk_sum"),
    )

    d = F.col("day")
    cnt = F.col("cnt")
    temp_max = F.lit(15.0) + F.col("q_max") / 2
    temp_min = F.lit(5.0) + F.col("q_min") / 2
    wind = (F.col("pk_min") % 40).cast("double")
    hum = F.col("okpk_sum") % 101
    return g.select(
        F.col("id").cast("long").alias("id"),
        d.alias("date"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("region"),
        (F.col("n_nationkey") - 12).cast("double").alias("latitude"),
        (F.col("n_regionkey") * 5).cast("double").alias("longitude"),
        F.concat(F.lit("zone_"), (F.col("n_nationkey") % 3).cast("string")).alias("zone_climatique"),
        F.month(d).alias("mois"),
        F.year(d).alias("annee"),
        F.quarter(d).alias("trimestre"),
        F.when(F.month(d).isin(11, 12, 1, 2, 3), F.lit("seche")).otherwise(F.lit("pluies")).alias("saison"),
        F.weekday(d).alias("jour_semaine"),
        temp_max.alias("temp_max"),
        temp_min.alias("temp_min"),
        ((temp_max + temp_min) / 2).alias("temp_mean"),
        (temp_max - (cnt % 5)).alias("feels_like_max"),
        (F.col("ln_min") * 2).cast("double").alias("dew_point_2m_mean"),
        F.when(hum != 50, hum).cast("double").alias("relative_humidity_2m_mean"),
        (F.lit(1000) + F.col("sk_sum") % 30).cast("double").alias("pressure_msl_mean"),
        (F.lit(200) + F.col("sk_sum") % 1500).cast("double").alias("boundary_layer_height_mean"),
        wind.alias("wind_speed_max"),
        (wind + F.col("pk_max") % 20).alias("wind_gusts_max"),
        ((F.col("pk_sum") % 1441) / 2 - 360).cast("double").alias("wind_direction"),
        F.when(cnt % 3 == 0, F.lit(0.0)).otherwise(F.col("ln_sum").cast("double")).alias("precipitation"),
        (F.col("pk_sum") % 30).cast("double").alias("shortwave_radiation_sum"),
        (F.lit(43200) + 60 * (F.dayofyear(d) % 60)).cast("double").alias("daylight_duration"),
        (3600 * (cnt % 12)).cast("double").alias("sunshine_duration"),
        F.when(cnt % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("cat_"), (cnt % 4).cast("string"))).alias("categorie_meteo"),
    )


def observations_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense short series: one row per (user, day), target = mean value.

    The region of a user is the event type of its lowest event id.  Both
    aggregates are computed per (user, day) with map-side partial
    aggregation, then a second aggregate over the user-day rows picks the
    region: no event-level shuffle beyond the first aggregation, and a hot
    user is pre-aggregated before it moves.
    """
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    day = ev.groupBy("user_id", F.to_date("ts").alias("date")).agg(
        F.avg("value").alias("valeur"),
        F.min_by("event_type", "event_id").alias("first_type"),
        F.min("event_id").alias("first_id"),
        F.count(F.lit(1)).alias("n_events"),
    )
    region = day.groupBy("user_id").agg(
        F.min_by("first_type", "first_id").alias("region"))
    return (day.join(region, "user_id")
            .select(F.col("user_id").cast("string").alias("ville"), "region", "date",
                    "valeur", "first_id"))
