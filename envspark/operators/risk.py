"""Daily city means, recent trend, city risk ranking,
regional health alerts and rule-based recommendations.

Every operator first reduces to the (city, day) or (city) / (region) grain
with map-side partial aggregation; cross-city scaling uses a ONE-ROW
min/max table broadcast back (never a single-partition window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envspark import config as C
from envspark.functions.exprs import band_label, clip, np_round, py_round
from envspark.functions.windows import last_k


def first_valid(c: str, order: tuple[str, ...] = ("date", "identifiant")) -> Column:
    """First non-missing value in (date, row key) order, deterministic.
    Rows with a missing value, or a missing order key, are ignored by
    ``min_by``; missing dates sort last like pandas."""
    present = [o for o in order]
    key = F.struct(F.col(present[0]).isNull(), *[F.col(o) for o in present])
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), key))


def daily_city_mean(df: DataFrame, target: str = "proxy_pm25", city: str = "ville") -> DataFrame:
    """Mean per (city, day); only observed days; a day whose values are
    all missing stays as a missing day; a missing date is dropped."""
    return (df.where(F.col("date").isNotNull() & F.col(city).isNotNull())
              .groupBy(city, "date").agg(F.avg(target).alias(target)))


def recent_delta(daily: DataFrame, target: str = "proxy_pm25", city: str = "ville",
                 window: int = C.RISK_TREND_WINDOW, minimum: int = C.RISK_TREND_MIN) -> DataFrame:
    """Over the last 14 observed days of each city, mean of the last 7
    minus mean of the older ones when at least 8 days exist, else 0.0.

    The last 14 days are selected in two phases (per city-year, then per
    city), so no window sorts a whole city."""
    last = last_k(daily, [city], [F.col("date").desc()], window, F.year("date"))
    recent = F.when(F.col("_rn") <= 7, F.col(target))
    older = F.when(F.col("_rn") > 7, F.col(target))
    return last.groupBy(city).agg(
        F.when(F.count(F.lit(1)) >= minimum, F.avg(recent) - F.avg(older))
         .otherwise(F.lit(0.0)).alias("tendance_7j"))


def _scale01(x: str, stats: str) -> Column:
    """Min-max across the cities of the slice: all missing -> 0.0,
    constant -> 0.5, else clipped (missing stays missing)."""
    lo, hi = F.col(f"{stats}_min"), F.col(f"{stats}_max")
    return (F.when(hi.isNull(), F.lit(0.0))
             .when(hi == lo, F.lit(0.5))
             .otherwise(clip((F.col(x) - lo) / (hi - lo), 0, 1)))


def city_risk(df: DataFrame, target: str = "proxy_pm25") -> DataFrame:
    """Per-city risk score 0-100 with level bands, sorted by score then
    mean (missing last)."""
    base = df.where(F.col("ville").isNotNull()).groupBy("ville").agg(
        first_valid("region").alias("region"),
        F.avg(target).alias("pm25_moyen"),
        F.avg("alerte_pollution").alias("pct_alerte"),
        first_valid("latitude").alias("latitude"),
        first_valid("longitude").alias("longitude"),
    )
    trend = recent_delta(daily_city_mean(df, target), target)
    # H1: left join, cities without dated rows keep a missing trend.
    j = base.join(trend, "ville", "left").withColumns({
        "_c_pm": F.col("pm25_moyen"),
        "_c_pct": F.col("pct_alerte") * F.lit(100.0),
        "_c_tr": F.when(F.col("tendance_7j").isNotNull(), F.greatest(F.col("tendance_7j"), F.lit(0.0))),
    })
    stats = j.agg(*[e for c in ("_c_pm", "_c_pct", "_c_tr")
                    for e in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))])
    w_pm, w_pct, w_tr = C.CITY_RISK_WEIGHTS
    s = j.crossJoin(F.broadcast(stats))
    score = (F.lit(w_pm) * _scale01("_c_pm", "_c_pm") + F.lit(w_pct) * _scale01("_c_pct", "_c_pct")
             + F.lit(w_tr) * _scale01("_c_tr", "_c_tr")) * F.lit(100.0)
    out = s.select(
        "ville", "region", "pm25_moyen",
        np_round(F.col("pct_alerte") * F.lit(100.0), 1).alias("pct_alerte"),
        "latitude", "longitude",
        np_round(F.col("tendance_7j"), 1).alias("tendance_7j"),
        np_round(score, 1).alias("score_risque"),
    )
    return out.withColumn("niveau_risque", band_label(F.col("score_risque"), C.RISK_BAND_LABELS)) \
        .orderBy(F.col("score_risque").desc_nulls_last(), F.col("pm25_moyen").desc_nulls_last(), F.col("ville"))


def region_alerts(df: DataFrame, target: str = "proxy_pm25") -> DataFrame:
    """Regional health score 0.65 mean + 0.35 alert %, clipped, rounded;
    level Vert..Rouge on right-closed bands; message on >= 70/50/30 (T8)."""
    w_pm, w_pct = C.REGION_SCORE_WEIGHTS
    reg = df.groupBy("region").agg(F.avg(target).alias("pm25_moyen"),
                                   (F.avg("alerte_pollution") * F.lit(100.0)).alias("pct_alerte"))
    score = np_round(clip(F.lit(w_pm) * F.col("pm25_moyen") + F.lit(w_pct) * F.col("pct_alerte"), 0, 100), 1)
    reg = reg.withColumn("score_sanitaire", score)
    msg = None
    for thr, text in C.REGION_MESSAGES:
        cond = F.col("score_sanitaire") >= F.lit(float(thr))
        msg = F.when(cond, F.lit(text)) if msg is None else msg.when(cond, F.lit(text))
    return reg.withColumns({
        "niveau": band_label(F.col("score_sanitaire"), C.REGION_BAND_LABELS),
        "message": msg.otherwise(F.lit(C.REGION_MESSAGE_DEFAULT)),
    }).orderBy(F.col("score_sanitaire").desc_nulls_last(), "region")


def _py_float_str(x: Column) -> Column:
    """Python ``str(float)`` of a value already rounded to one decimal."""
    return F.when(x.isNull(), F.lit("nan")).otherwise(x.cast("string"))


def recommendations(df: DataFrame, risk: DataFrame, threshold: DataFrame,
                    label: str = "Proxy PM2.5") -> DataFrame:
    """Ordered rule-based recommendation list (rank, code, text).

    ``threshold`` is a one-row table with column ``seuil``.  All inputs are
    one-row aggregates or the top 3 of the city ranking; the list is built by
    a filter over an array of candidate structs and ``posexplode``."""
    cols = set(df.columns)
    g = df.agg(
        F.coalesce(F.avg("proxy_pm25"), F.lit(0.0)).alias("_pm"),
        F.coalesce(F.avg("alerte_pollution") * F.lit(100.0), F.lit(0.0)).alias("_pct"),
        (F.avg("vitesse_vent_max") if "vitesse_vent_max" in cols else F.lit(None).cast("double")).alias("_wind"),
        (F.avg("precipitation") if "precipitation" in cols else F.lit(None).cast("double")).alias("_rain"),
        (F.avg("temp_max") if "temp_max" in cols else F.lit(None).cast("double")).alias("_temp"),
    )
    w = Window.orderBy(F.col("score_risque").desc_nulls_last(), F.col("pm25_moyen").desc_nulls_last(),
                       F.col("ville"))
    # top-3 of a city-grain table: a tiny sort, bounded by the number of cities
    top = (risk.select("ville", "region", "score_risque", "pm25_moyen").orderBy(
        F.col("score_risque").desc_nulls_last(), F.col("pm25_moyen").desc_nulls_last(), F.col("ville"))
        .limit(3).withColumn("_r", F.row_number().over(w)))
    topagg = top.agg(
        F.count(F.lit(1)).alias("_n_top"),
        F.max(F.when(F.col("_r") == 1, F.col("ville"))).alias("_v1"),
        F.max(F.when(F.col("_r") == 1, F.col("region"))).alias("_reg1"),
        F.max(F.when(F.col("_r") == 1, F.col("score_risque"))).alias("_s1"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "ville"))), lambda s: s["ville"]),
                     ", ").alias("_top3"),
    )
    n_cities = risk.agg(F.count(F.lit(1)).alias("_n_cities"))
    j = g.crossJoin(topagg).crossJoin(n_cities).crossJoin(threshold.select("seuil"))
    seuil = F.col("seuil")
    cands = [
        (1, F.when(F.col("_pm") >= C.RECO_PROXY_HIGH, F.lit(C.RECO_HIGH))
             .when(F.col("_pm") >= C.RECO_PROXY_MEDIUM, F.lit(C.RECO_MEDIUM))
             .otherwise(F.lit(C.RECO_LOW))),
        (2, F.when(F.col("_pct") >= C.RECO_ALERT_PCT, F.lit(C.RECO_ALERT_SHARE))),
        (3, F.when(F.col("_wind") < C.RECO_WIND_LT, F.lit(C.RECO_LOW_WIND))),
        (4, F.when(F.col("_rain") < C.RECO_PRECIP_LT, F.lit(C.RECO_DRY))),
        (5, F.when(F.col("_temp") > C.RECO_TEMP_GT, F.lit(C.RECO_HEAT))),
        (6, F.when(F.col("_n_cities") > 0, F.format_string(
            C.RECO_TOP_CITY.replace("{ville}", "%s").replace("{region}", "%s").replace("{score}", "%s"),
            F.col("_v1"), F.coalesce(F.col("_reg1"), F.lit("nan")), _py_float_str(F.col("_s1"))))),
        (7, F.when(F.col("_n_cities") >= 3, F.format_string(
            C.RECO_TOP3.replace("{villes}", "%s"), F.col("_top3")))),
        # a NaN threshold is truthy in the reference and prints as "nan"
        (8, F.when(seuil.isNull() | (seuil != 0), F.format_string(
            C.RECO_THRESHOLD.replace("{label}", "%s").replace("{seuil}", "%s"),
            F.lit(label), F.coalesce(py_round(seuil, 1).cast("string"), F.lit("nan"))))),
    ]
    arr = F.array(*[F.struct(F.lit(code).alias("code"), txt.alias("text")) for code, txt in cands])
    return (j.select(F.posexplode(F.filter(arr, lambda s: s["text"].isNotNull())).alias("pos", "r"))
              .select((F.col("pos") + 1).alias("rang"), F.col("r.code").alias("code"),
                      F.col("r.text").alias("texte")))
