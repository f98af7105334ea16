"""G. Aggregations and rollups (G1-G16), D4 daily trend, D9 history tail,
A9/A10 summaries and the M5 data browser.

Every rollup is a ``groupBy`` with map-side partial aggregation; group-wise
statistics that need a second pass (box whiskers, histogram) join a small
per-group statistics table back (broadcast when its size is bounded by the
group count).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from envspark import config as C
from envspark.functions.exprs import (band_ordinal, label_of, level_expr, month_label, np_round,
                                      safe_corr, wind_regime, wind_sector_ordinal)
from envspark.functions.joins import join_keys
from envspark.functions.quantiles import exact_quantiles
from envspark.functions.windows import last_k
from envspark.operators.risk import city_risk, first_valid


def with_level(df: DataFrame, target: str, cfg: C.TargetConfig, out: str = "niveau_target") -> DataFrame:
    """F1 applied to a column."""
    return df.withColumn(out, level_expr(F.col(target), cfg))


def _level_ordinal(x, cfg: C.TargetConfig):
    if cfg.is_classification:
        return x.cast("int") + F.lit(1)
    return band_ordinal(x, cfg.edges or C.BAND_EDGES)


def kpis(df: DataFrame, target: str = "proxy_pm25", cfg: C.TargetConfig | None = None) -> DataFrame:
    """G1: mean target, alert-day %, mean temp max, mean wind, mean city
    risk score and the most frequent level (ties -> first level, T15)."""
    cfg = cfg or C.target_config(target)
    cols = set(df.columns)
    g = df.agg(
        F.avg(target).alias("target_mean"),
        (F.avg("alerte_pollution") * F.lit(100.0)).alias("pct_alerte"),
        (F.avg("temp_max") if "temp_max" in cols else F.lit(0.0)).cast("double").alias("temp_moy"),
        (F.avg("vitesse_vent_max") if "vitesse_vent_max" in cols else F.lit(0.0)).cast("double").alias("vent_moy"),
    )
    risk = city_risk(df).agg(F.coalesce(F.avg("score_risque"), F.lit(0.0)).alias("score_risque_moy"))
    lv = (df.select(_level_ordinal(F.col(target), cfg).alias("o")).where(F.col("o").isNotNull())
            .groupBy("o").agg(F.count(F.lit(1)).alias("n")))
    labels = list(cfg.band_labels) if cfg.band_labels else [C.CLASS_LABELS[0], C.CLASS_LABELS[1]]
    mode = lv.agg(F.max_by(F.col("o"), F.struct(F.col("n"), -F.col("o"))).alias("o")) \
             .select(label_of(F.col("o"), labels).alias("niveau_mode"))
    return g.crossJoin(risk).crossJoin(mode)


def city_map(df: DataFrame, target: str = "proxy_pm25", cfg: C.TargetConfig | None = None) -> DataFrame:
    """Per city mean target and alert % (rounded to 1), first
    position/region, mean temperature, then the level of the rounded mean."""
    cfg = cfg or C.target_config(target)
    aggs = [F.avg(target).alias("_t"), first_valid("latitude").alias("latitude"),
            first_valid("longitude").alias("longitude"), first_valid("region").alias("region"),
            F.avg("alerte_pollution").alias("_a")]
    if "temp_max" in df.columns:
        aggs.append(F.avg("temp_max").alias("temp"))
    g = df.where(F.col("ville").isNotNull()).groupBy("ville").agg(*aggs)
    g = g.withColumns({"target_value": np_round(F.col("_t"), 1),
                       "alerte_pct": np_round(F.col("_a") * F.lit(100.0), 1)}).drop("_t", "_a")
    return with_level(g, "target_value", cfg, "niveau")


def monthly_mean(df: DataFrame, target: str = "proxy_pm25") -> DataFrame:
    """G3 + B10: mean per month with its label."""
    return (df.groupBy("mois").agg(F.avg(target).alias(target))
              .withColumn("mois_nom", month_label(F.col("mois"))))


def yearly_region_mean(df: DataFrame, target: str = "proxy_pm25") -> DataFrame:
    """Mean per (year, region)."""
    return df.groupBy("annee", "region").agg(F.avg(target).alias(target))


def level_counts(df: DataFrame, col: str = "niveau_alerte",
                 labels: Sequence[str] = C.PROXY_BAND_LABELS) -> DataFrame:
    """Day count per level, every level listed (zero counts kept, T21)."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(i + 1, s) for i, s in enumerate(labels)], "ordre int, Niveau string")
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("Niveau")).agg(
        F.count(F.lit(1)).alias("Jours"))
    return (F.broadcast(dim).join(counts, "Niveau", "left")
            .select("Niveau", F.coalesce(F.col("Jours"), F.lit(0)).cast("long").alias("Jours"), "ordre"))


def alert_share_by_region(df: DataFrame) -> DataFrame:
    """Mean alert flag per region and its percent rounded to 1, highest first."""
    return (df.groupBy("region").agg(F.avg("alerte_pollution").alias("alerte_pollution"))
              .withColumn("pct", np_round(F.col("alerte_pollution") * F.lit(100.0), 1))
              .orderBy(F.col("alerte_pollution").desc_nulls_last(), "region"))


def region_median_order(df: DataFrame, target: str = "proxy_pm25") -> DataFrame:
    """Exact median per region, in the order of the box plots (highest first)."""
    return exact_quantiles(df, target, [0.5], by=["region"], names=["mediane"]) \
        .orderBy(F.col("mediane").desc_nulls_last(), "region")


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles (linear), whiskers at the last datum inside 1.5 IQR,
    outlier count, per group.  Two passes: per-group quartiles (one row per
    group, joined back) then conditional min/max/count."""
    x = F.col(value)
    base = df.where(x.isNotNull()).select(F.col(group).alias("groupe"), x.alias("v"))
    n = base.groupBy("groupe").agg(F.count(F.lit(1)).alias("n"))
    qs = exact_quantiles(base, "v", [0.25, 0.5, 0.75], by=["groupe"], names=["q1", "mediane", "q3"])
    q = join_keys(n, qs, ["groupe"])
    q = q.withColumns({"_lo": F.col("q1") - F.lit(1.5) * (F.col("q3") - F.col("q1")),
                       "_hi": F.col("q3") + F.lit(1.5) * (F.col("q3") - F.col("q1"))})
    q = q.withColumnRenamed("groupe", "_g")
    # one row per group: AQE broadcasts it when its measured size is small
    j = base.join(q, base.groupe.eqNullSafe(q._g)).drop("_g")
    v = F.col("v")
    return j.groupBy("groupe").agg(
        F.first("n").alias("n"), F.first("q1").alias("q1"), F.first("mediane").alias("mediane"),
        F.first("q3").alias("q3"),
        F.min(F.when(v >= F.col("_lo"), v)).alias("moustache_basse"),
        F.max(F.when(v <= F.col("_hi"), v)).alias("moustache_haute"),
        F.count_if((v < F.col("_lo")) | (v > F.col("_hi"))).alias("n_extremes"))


def wind_rose_counts(df: DataFrame, target: str = "proxy_pm25") -> DataFrame:
    """G9 + F2: frequency per observed sector (direction and target present)."""
    d = df.where(F.col("direction_vent").isNotNull() & F.col(target).isNotNull())
    return (d.groupBy(wind_sector_ordinal(F.col("direction_vent")).alias("ordre"))
             .agg(F.count(F.lit(1)).alias("frequence"))
             .withColumn("secteur", label_of(F.col("ordre"), C.WIND_SECTOR_LABELS)))


def wind_rose_mean(df: DataFrame, target: str = "proxy_pm25") -> DataFrame:
    """Mean target per observed sector."""
    d = df.where(F.col("direction_vent").isNotNull() & F.col(target).isNotNull())
    return (d.groupBy(wind_sector_ordinal(F.col("direction_vent")).alias("ordre"))
             .agg(F.avg(target).alias(target))
             .withColumn("secteur", label_of(F.col("ordre"), C.WIND_SECTOR_LABELS)))


def with_regime(df: DataFrame, target: str = "proxy_pm25") -> DataFrame:
    """F3 on the rows where direction, target and month are all present."""
    d = df.where(F.col("direction_vent").isNotNull() & F.col(target).isNotNull() & F.col("mois").isNotNull())
    return d.withColumn("regime", wind_regime(F.col("direction_vent"), F.col("mois")))


def regime_stats(df: DataFrame, target: str = "proxy_pm25") -> DataFrame:
    """Mean and count per wind regime."""
    return (with_regime(df, target).groupBy(F.col("regime").alias("Regime"))
            .agg(F.avg(target).alias("valeur_moyenne"), F.count(target).alias("nb_jours")))


def target_correlations(df: DataFrame, target: str = "proxy_pm25",
                        variables: Sequence[str] = C.CORR_VARS) -> DataFrame:
    """Pearson correlation of each present variable with the target,
    pairwise complete, constant -> missing (T19); one aggregate pass, then
    ``stack`` to rows."""
    vars_ = [v for v in variables if v in df.columns and v != target]
    t = F.col(target)
    row = df.agg(*[safe_corr(F.col(v), t).alias(v) for v in vars_])
    stack = "stack({n}, {items}) as (variable, correlation)".format(
        n=len(vars_), items=", ".join(f"'{v}', `{v}`" for v in vars_))
    return row.selectExpr(stack)


def month_region_pivot(df: DataFrame, target: str = "proxy_pm25") -> DataFrame:
    """Mean per (region, month) pivoted with fixed month values (no
    distinct-values job), columns named by month label."""
    months = list(C.MONTH_NAMES)
    p = df.groupBy("region").pivot("mois", months).agg(F.avg(target))
    return p.select("region", *[F.col(str(m)).alias(C.MONTH_NAMES[m]) for m in months])


def season_by_month(df: DataFrame) -> DataFrame:
    """Per (city, month), the most frequent non-missing season (ties ->
    smallest); the city's last known season and overall mode are carried as
    fallbacks for months without observations."""
    s = df.where(F.col("saison").isNotNull() & F.col("ville").isNotNull())
    cm = s.groupBy("ville", "mois", "saison").agg(F.count(F.lit(1)).alias("n"))
    # per (city, month) the list holds one entry per distinct season: bounded
    by_month = cm.groupBy("ville", "mois").agg(
        F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("saison").alias("s"))).alias("_c"))
    by_month = by_month.select("ville", "mois", F.array_min("_c")["s"].alias("saison_mois"))
    overall = cm.groupBy("ville", "saison").agg(F.sum("n").alias("n")).groupBy("ville").agg(
        F.array_min(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("saison").alias("s"))))["s"]
        .alias("saison_mode"))
    last = s.groupBy("ville").agg(
        F.max_by("saison", F.struct(F.col("date").isNull(), F.col("date"), F.col("identifiant")))
        .alias("saison_derniere"))
    return by_month.join(last, "ville", "left").join(overall, "ville", "left")


def histogram(df: DataFrame, col: str, bins: int = C.HIST_BINS) -> DataFrame:
    """``bins`` equal-width bins from min to max, last edge closed,
    zero-count bins kept (numpy convention; a constant column is centred in
    a unit range)."""
    spark = df.sparkSession
    x = F.col(col)
    vals = df.where(x.isNotNull()).select(x.cast("double").alias("v"))
    st = vals.agg(F.min("v").alias("_a"), F.max("v").alias("_b")).select(
        F.when(F.col("_a") == F.col("_b"), F.col("_a") - F.lit(0.5)).otherwise(F.col("_a")).alias("lo"),
        F.when(F.col("_a") == F.col("_b"), F.col("_b") + F.lit(0.5)).otherwise(F.col("_b")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    idx = F.least(F.floor((F.col("v") - F.col("lo")) / width).cast("int"), F.lit(bins - 1))
    counts = vals.crossJoin(F.broadcast(st)).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    dim = spark.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(st))
    return (dim.join(counts, "bin", "left")
            .select("bin",
                    (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / F.lit(float(bins))).alias("borne_basse"),
                    (F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / F.lit(float(bins))).alias("borne_haute"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def outcome_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """G15 for classification: number of correct and wrong predictions
    (both rows always present)."""
    d = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    g = d.agg(F.count_if(F.col(y) == F.col(p)).alias("correct"), F.count_if(F.col(y) != F.col(p)).alias("wrong"))
    return g.selectExpr("stack(2, 'correct', correct, 'wrong', wrong) as (resultat, n)")


def class_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """Count of each class among true labels and among predictions."""
    st = df.select(F.expr(f"stack(2, 'reel', `{y}`, 'predit', `{p}`) as (serie, classe)"))
    return st.groupBy("serie", "classe").agg(F.count(F.lit(1)).alias("n"))


def daily_trend(df: DataFrame, target: str = "proxy_pm25") -> DataFrame:
    """Mean per date and the 7-row moving average including the current
    row.  The window runs over one row per calendar day, however many
    observations there are."""
    daily = df.where(F.col("date").isNotNull()).groupBy("date").agg(F.avg(target).alias(target))
    return daily.withColumn("moyenne_mobile_7j", F.avg(target).over(Window.orderBy("date").rowsBetween(-6, 0)))


def history_tail(df: DataFrame, target: str = "proxy_pm25", days: int = 60) -> DataFrame:
    """Per city, daily mean over the last ``days`` observed dates."""
    daily = (df.where(F.col("date").isNotNull() & F.col(target).isNotNull() & F.col("ville").isNotNull())
               .groupBy("ville", "date").agg(F.avg(target).alias(target)))
    return last_k(daily, ["ville"], [F.col("date").desc()], days, F.year("date")).drop("_rn")


def data_browser(df: DataFrame, target: str = "proxy_pm25", level_col: str | None = "niveau_target",
                 rows: int = C.BROWSER_ROWS) -> DataFrame:
    """M5: the listed columns that exist, first ``rows`` rows in (city, date) order."""
    cols = [c for c in C.BROWSER_COLS + [target] + ([level_col] if level_col else []) if c in df.columns]
    order = [F.col("ville").asc_nulls_last(), F.col("date").asc_nulls_last()]
    if "identifiant" in df.columns:
        order.append(F.col("identifiant"))
    return df.orderBy(*order).select(*cols).limit(rows)
