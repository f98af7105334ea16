"""Skewed fixture derived from the driver tables: nations 0-7 are relabelled
into one hot city (about a third of all rows).  The split paths must give
the same results as the plain paths."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from envspark.functions.quantiles import exact_quantiles
from envspark import config as C
from envspark.functions.windows import last_k, range_starts
from envspark.operators import features
from envspark.plans.prepare import clean_observations
from envspark.session import materialize
from envspark.sources.observations import observations_from_orders

SF = "/root/testdata/sf0.001"
_WRITTEN: dict = {}


def skewed(spark):
    raw = observations_from_orders(spark, SF)
    hot = F.when(F.regexp_extract("city", r"(\d+)$", 1).cast("int") < 8, F.lit("HOT")).otherwise(F.col("city"))
    if "table" not in _WRITTEN or _WRITTEN["table"].sparkSession is not spark:
        _WRITTEN["table"] = materialize(clean_observations(raw.withColumn("city", hot)), "skewed")
    return _WRITTEN["table"]


def test_hot_city_share(spark):
    df = skewed(spark)
    share = df.where(F.col("ville") == "HOT").count() / df.count()
    assert share > 0.25


def plain_lags(df):
    return df.withColumns(features.lag_window_columns(features.city_order_window(), C.LAG_VARS))


def test_split_lags_equal_plain_on_hot_city(spark):
    df = skewed(spark)
    cols = ["identifiant", "temp_max_lag1", "temp_max_lag7", "humidite_moy_moy7j", "precipitation_moy7j"]
    a = features.add_lags_and_trailing(df).select(*cols)
    b = plain_lags(df).select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_hot_city_in_one_year_is_split(spark):
    df = skewed(spark).withColumn("date", F.when(F.col("ville") == "HOT", F.date_add(F.lit("1995-01-01").cast("date"), F.dayofyear("date") - 1))
                                  .otherwise(F.col("date")))
    cols = ["identifiant", "temp_max_lag1", "temp_max_lag7", "humidite_moy_moy7j"]
    a = features.add_lags_and_trailing(df).select(*cols)
    b = plain_lags(df).select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    starts = range_starts(df, "ville", ["date", "identifiant"], 16).where("ville = 'HOT'").first()["_starts"]
    assert len(starts) >= 3


def test_distributed_quantiles_on_hot_group(spark):
    df = skewed(spark)
    a = exact_quantiles(df, "temp_max", [0.25, 0.5, 0.8], by=["ville"])
    b = df.groupBy("ville").agg(F.percentile("temp_max", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.8))).alias("q"))
    b = b.select("ville", *[F.col("q")[i].alias(f"q{i}") for i in range(3)])
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_exact_quantiles_of_many_distinct_values(spark):
    df = spark.range(200_000).select((F.col("id") % 7).alias("g"), F.exp(F.randn(3) * 4).alias("v"))
    probs = [0.0, 0.001, 0.25, 0.5, 0.9999, 1.0]
    for by in ([], ["g"]):
        a = exact_quantiles(df, "v", probs, by=by).collect()
        q = F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")
        b = (df.groupBy(*by) if by else df).agg(q).collect()
        assert sorted(tuple(r) for r in a) == sorted((*r[:-1], *r[-1]) for r in b)


def test_two_phase_last_k_equals_window(spark):
    df = skewed(spark)
    a = last_k(df, ["ville"], [F.col("date").desc(), F.col("identifiant").desc()], 14, F.year("date"))
    w = Window.partitionBy("ville").orderBy(F.col("date").desc(), F.col("identifiant").desc())
    b = df.withColumn("_rn", F.row_number().over(w)).where("_rn <= 14")
    ka = a.select("identifiant", "_rn")
    kb = b.select("identifiant", "_rn")
    assert ka.exceptAll(kb).count() == 0 and kb.exceptAll(ka).count() == 0


def hot_day(spark):
    """One city: a third of its rows on one day, a third without a date."""
    df = skewed(spark).withColumn("_k", F.row_number().over(Window.partitionBy("ville").orderBy("identifiant")))
    day = F.when((F.col("ville") == "HOT") & (F.col("_k") % 3 == 0), F.lit("1996-05-05").cast("date")) \
        .when((F.col("ville") == "HOT") & (F.col("_k") % 3 == 1), F.lit(None).cast("date")).otherwise(F.col("date"))
    return df.withColumn("date", day).drop("_k")


def test_hot_day_and_missing_dates_are_split(spark):
    df = hot_day(spark)
    parts = 48
    starts = range_starts(df, "ville", ["date", "identifiant"], parts).collect()
    assert sum(len(r["_starts"]) for r in starts) <= 2 * parts
    hot = next(r["_starts"] for r in starts if r["ville"] == "HOT")
    days = [s["_d"] for s in hot]
    assert len([d for d in set(days) if days.count(d) >= 2]) >= 2          # the day and the dateless rows are both cut
    # rows of each bucket of the hot city stay near the share of one task
    city = df.where("ville = 'HOT'").select(F.coalesce(F.unix_date("date"), F.lit(1 << 30)).alias("d"), "identifiant").collect()
    keys = [(s["_d"], s["_i"]) for s in hot]
    load = {}
    for r in city:
        b = sum(k <= (r["d"], r["identifiant"]) for k in keys)
        load[b] = load.get(b, 0) + 1
    assert max(load.values()) <= 2.2 * df.count() / parts
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        cols = ["identifiant", "temp_max_lag1", "temp_max_lag7", "humidite_moy_lag7", "humidite_moy_moy7j", "precipitation_moy7j"]
        a = features.add_lags_and_trailing(df).select(*cols)
        b = plain_lags(df).select(*cols)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_group_is_split_without_skew(spark):
    df = skewed(spark).where("ville <> 'HOT'")
    assert range_starts(df, "ville", ["date", "identifiant"], 2).isEmpty()
    text = features.add_lags_and_trailing(df)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Window [") == 1 and "Union" not in text


def test_brackets_are_narrowed_until_one_task_can_order_them(spark, monkeypatch):
    import envspark.functions.quantiles as Q
    df = spark.range(1_500_000).select((F.col("id") % 3 == 0).alias("g"), ((F.col("id") * 7919) % 1_500_007).cast("double").alias("v"),
                                       F.when(F.col("id") % 2 == 0, (F.col("id") * 104729 % 1_500_007).cast("double")).alias("u"))
    monkeypatch.setattr(Q, "ACCURACY", 5)               # first brackets: nearly all values
    monkeypatch.setattr(Q, "BRACKET_VALUES", 10_000)
    seen = []
    narrow = Q._narrow

    def recorded(*args):
        out = narrow(*args)
        seen.append(out[1])
        return out
    monkeypatch.setattr(Q, "_narrow", recorded)
    probs = [0.0, 0.25, 0.5, 0.8, 1.0]
    for by in ([], ["g"]):
        seen.clear()
        a = sorted(tuple(r) for r in Q.exact_quantiles(df, "v", probs, by=by).collect())
        q = F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")
        b = sorted((*r[:-1], *r[-1]) for r in (df.groupBy(*by) if by else df).agg(q).collect())
        assert a == b and len(seen) >= 2 and seen[0] > 300_000 and seen[-1] <= 10_000
    seen.clear()
    assert tuple(Q.exact_medians_wide(df, ["v", "u"]).first()) == tuple(df.agg(F.percentile("v", 0.5), F.percentile("u", 0.5)).first())
    assert seen[0] > 1_000_000 and seen[-1] <= 10_000


def test_rows_are_not_shuffled_on_the_group(spark):
    df = skewed(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        plan = exact_quantiles(df, "temp_max", [0.25, 0.5], by=["region"])._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_score_ranges_follow_the_size_of_a_group(spark):
    from envspark.functions.quantiles import _range_cuts, cumulative_counts
    df = spark.range(20_000).select(F.when(F.col("id") < 18_000, F.lit("big")).when(F.col("id") < 19_900, F.lit("small")).otherwise(F.lit(None)).alias("g"),
                                    (F.col("id") * 7 % 20_011).cast("double").alias("s"), (F.col("id") % 5).alias("n"))
    cuts = {r["g"]: len(r["_cuts"]) for r in _range_cuts(df.withColumn("_o", F.col("s")), ["g"], 20).collect()}
    assert cuts == {"big": 17}
    a = cumulative_counts(df, "s", ["n"], ["g"]).select("g", "s", "_cn")
    w = Window.partitionBy("g").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    b = df.select("g", "s", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_cn"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
