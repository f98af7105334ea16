"""J. Forecasting for ALL cities in one job, plus D7 (recent slope),
D8 (calendar densify + linear interpolation) and D10 (last valid value).

Nothing loops on the driver and nothing grows: each recursion keeps a
bounded state (the last <= 14 values of a series) and is folded inside
Catalyst with the ``aggregate`` higher-order function over
``sequence(1, horizon)``; ``posexplode`` turns the folded array into rows.
Every per-city step first reduces to the (city, day) grain and to the last
14 values, so the work per city is bounded by the horizon, not the history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envspark import config as C
from envspark.functions.exprs import bound_rule, level_expr
from envspark.functions.joins import join_keys
from envspark.functions.windows import last_k, year_bucket
from envspark.operators import features


# --- D8: densify + interpolate ------------------------------------------------

def densify_daily(daily: DataFrame, value: str, city: str = "ville",
                  start: Column | None = None) -> DataFrame:
    """Full daily calendar per city from its first (or ``start``) to its
    last observed day, linear interpolation between observed neighbours
    (values outside the observed range take the nearest observation).

    ``daily`` has one row per (city, date).  The calendar is generated per
    city with ``sequence`` + ``explode`` (bounded by the city's span) and the
    neighbours are found with ``last``/``first`` ignoring nulls over
    per-city windows."""
    span = daily.groupBy(city).agg(F.min("date").alias("_d0"), F.max("date").alias("_d1"))
    if start is not None:
        span = span.withColumn("_d0", F.greatest(F.col("_d0"), start))
    cal = span.select(city, F.explode(F.sequence("_d0", "_d1", F.expr("INTERVAL 1 DAY"))).alias("date"))
    obs = daily.select(city, "date", F.col(value).alias("_v"))
    # keep the last observation before the calendar start as left anchor
    j = cal.join(obs, [city, "date"], "left")
    anchor = (obs.join(span.select(city, "_d0"), city)
                 .where(F.col("date") < F.col("_d0"))
                 .groupBy(city).agg(F.max_by(F.struct("date", "_v"), "date").alias("_a"))
                 .select(city, F.col("_a.date").alias("date"), F.col("_a._v").alias("_v"),
                         F.lit(True).alias("_anchor")))
    u = j.withColumn("_anchor", F.lit(False)).unionByName(anchor)
    w = Window.partitionBy(city).orderBy("date")
    prev_v = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    prev_d = F.last(F.when(F.col("_v").isNotNull(), F.col("date")), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0))
    # "next" = last non-null in descending order: a running frame, not a
    # current-to-end frame (which Spark recomputes for every row)
    wr = Window.partitionBy(city).orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    next_v = F.last("_v", ignorenulls=True).over(wr)
    next_d = F.last(F.when(F.col("_v").isNotNull(), F.col("date")), ignorenulls=True).over(wr)
    u = u.withColumns({"_pv": prev_v, "_pd": prev_d, "_nv": next_v, "_nd": next_d})
    gap = F.datediff(F.col("_nd"), F.col("_pd")).cast("double")
    slope = (F.col("_nv") - F.col("_pv")) / gap
    interp = (F.when(F.col("_v").isNotNull(), F.col("_v"))
               .when(F.col("_pv").isNull(), F.col("_nv"))
               .when(F.col("_nv").isNull(), F.col("_pv"))
               .otherwise(slope * F.datediff(F.col("date"), F.col("_pd")).cast("double") + F.col("_pv")))
    return u.where(~F.col("_anchor")).select(city, "date", interp.alias(value),
                                             F.col("_v").isNull().alias("interpole"))


# --- J1 / J2: trend projection ---------------------------------------------------

def _mean_sql(arr: str, start: str, length: int) -> str:
    return f"(aggregate(slice({arr}, {start}, {length}), 0D, (a, x) -> a + x) / {float(length)})"


def forecast_trend(df: DataFrame, target: str = "proxy_pm25", horizon: int = 7,
                   cfg: C.TargetConfig | None = None, city: str = "ville",
                   clamp: bool | None = None) -> DataFrame:
    """Per city daily mean of the target; fewer than 7 observed days ->
    no rows; calendar densified and interpolated (D8) over the last 14
    days; start = mean of the last 7 calendar days, previous = mean of the
    7 before (or start when the series is shorter than 14 days); drift =
    difference / 7; each step adds the drift and clamps to [0, 100] unless
    the target is a class (T28); level by F1."""
    cfg = cfg or C.target_config(target)
    clamp = (not cfg.is_classification) if clamp is None else clamp
    daily = (df.where(F.col("date").isNotNull() & F.col(target).isNotNull() & F.col(city).isNotNull())
               .groupBy(city, "date").agg(F.avg(target).alias("_y")))
    base = _series_end(daily, city).where(F.col("_n") >= C.MIN_HISTORY_TREND).select(
        city, "_last", _dense_tail().alias("_arr"), (F.datediff("_last", "_first") + 1).alias("_len"))
    n = "size(_arr)"
    last7 = _mean_sql("_arr", f"{n} - 6", 7)
    prev7 = f"(CASE WHEN _len >= 14 THEN {_mean_sql('_arr', f'{n} - 13', 7)} ELSE {last7} END)"
    step = "greatest(0D, least(100D, acc.c + drift))" if clamp else "(acc.c + drift)"
    fold = F.expr(
        f"aggregate(sequence(1, {int(horizon)}), named_struct('c', s0, 'out', cast(array() as array<double>)), "
        f"(acc, i) -> named_struct('c', {step}, 'out', concat(acc.out, array({step}))), acc -> acc.out)")
    g = (base.withColumn("s0", F.expr(last7))
             .withColumn("drift", (F.col("s0") - F.expr(prev7)) / F.lit(7.0))
             .select(city, "_last", F.posexplode(fold).alias("_k", "prediction")))
    return g.select(city, F.date_add("_last", F.col("_k") + 1).alias("date"), "prediction",
                    level_expr(F.col("prediction"), cfg).alias("niveau"))


def _series_end(daily: DataFrame, city: str, keep: int = 15) -> DataFrame:
    """Per city: number of observed days, first and last day, and its last
    ``keep`` observations (``_s``, oldest first) -- all that the last 14
    calendar days and their left neighbour need.  One pass over the days: lists
    of at most a year's days per (city, year), then of ``keep`` per year."""
    def latest(lists):
        return F.slice(F.sort_array(lists, asc=False), 1, keep)
    year = daily.groupBy(city, F.year("date")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("date").alias("_first"), F.max("date").alias("_last"),
        latest(F.collect_list(F.struct("date", "_y"))).alias("_s"))
    return year.groupBy(city).agg(
        F.sum("_n").alias("_n"), F.min("_first").alias("_first"), F.max("_last").alias("_last"),
        F.reverse(latest(F.flatten(F.collect_list("_s")))).alias("_s"))


def _dense_tail() -> Column:
    """The last 14 calendar days of a series (D8 restricted to the window J1
    reads), interpolated between the observations in ``_s``."""
    def value(day):
        before = F.element_at(F.filter("_s", lambda o: o["date"] <= day), -1)
        after = F.get(F.filter("_s", lambda o: o["date"] >= day), 0)
        slope = (after["_y"] - before["_y"]) / F.datediff(after["date"], before["date"]).cast("double")
        return F.when(before["date"] == day, before["_y"]).otherwise(
            slope * F.datediff(day, before["date"]).cast("double") + before["_y"])
    start = F.greatest(F.col("_first"), F.date_sub(F.col("_last"), 13))
    return F.transform(F.sequence(start, F.col("_last"), F.expr("INTERVAL 1 DAY")), value)


def forecast_trend_fixed(df: DataFrame, target: str = "proxy_pm25", horizon: int = 7,
                         city: str = "ville") -> DataFrame:
    """The fixed-band variant (always clamped, proxy bands)."""
    return forecast_trend(df, target, horizon, C.target_config("proxy_pm25"), city, clamp=True)


# --- D10, D7, J3: covariate roll-forward ----------------------------------------

def last_valid(df: DataFrame, cols: Sequence[str], city: str = "ville") -> DataFrame:
    """Last non-missing value of each column per city, in (date, row key) order."""
    key = F.struct(F.col("date").isNull(), F.col("date"), F.col("identifiant"))
    return df.groupBy(city).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), key)).alias(c)
                                  for c in cols])


SLOPE_SQL = ("(CASE WHEN size({a}) >= 14 THEN ({m7} - {p7}) / 7D "
             "WHEN size({a}) >= 2 THEN (element_at({a}, size({a})) - element_at({a}, 1)) / (size({a}) - 1) "
             "ELSE 0D END)")


def slope_sql(arr: str) -> str:
    """D7 on an array holding the last <= 14 non-missing values (oldest first)."""
    return SLOPE_SQL.format(a=arr, m7=_mean_sql(arr, f"size({arr}) - 6", 7),
                            p7=_mean_sql(arr, f"size({arr}) - 13", 7))


def projection_columns(df: DataFrame) -> list[str]:
    return [c for c in C.PROJECTION_COLS if c in df.columns]


def recent_values(df: DataFrame, cols: Sequence[str], city: str = "ville", keep: int = 14) -> DataFrame:
    """Unpivot to (city, column, value) and keep the last ``keep`` non-missing
    values per (city, column) as an ordered array -- one shuffle for all
    columns; the per-group array is bounded by ``keep``."""
    stack = "stack({n}, {items}) as (colonne, valeur)".format(
        n=len(cols), items=", ".join(f"'{c}', cast(`{c}` as double)" for c in cols))
    long = df.select(city, "date", "identifiant", F.expr(stack)).where(F.col("valeur").isNotNull())
    last = last_k(long, [city, "colonne"], [F.col("date").desc_nulls_first(), F.col("identifiant").desc()],
                  keep, year_bucket("date"))
    return last.groupBy(city, "colonne").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_rn")).alias("k"), F.col("valeur").alias("v")))),
                    lambda s: s["v"]).alias("_arr"))


def recent_slopes(df: DataFrame, city: str = "ville") -> DataFrame:
    """D7 per (city, column) over the last 14 non-missing values."""
    cols = projection_columns(df)
    return recent_values(df, cols, city).select(city, "colonne", F.expr(slope_sql("_arr")).alias("pente"))


def _rule_expr(cols: Sequence[str]) -> Column:
    expr = None
    for c in cols:
        cond = F.col("colonne") == F.lit(c)
        expr = F.when(cond, F.lit(bound_rule(c))) if expr is None else expr.when(cond, F.lit(bound_rule(c)))
    return expr


def _bound_sql(v: str) -> str:
    return (f"(CASE WHEN _rule = 'percent' THEN greatest(0D, least(100D, {v})) "
            f"WHEN _rule = 'angle' THEN pmod({v}, 360D) "
            f"WHEN _rule = 'nonneg' THEN greatest(0D, {v}) ELSE {v} END)")


def eligible_cities(df: DataFrame, city: str = "ville", minimum: int = C.MIN_HISTORY_MODEL) -> DataFrame:
    return (df.where(F.col(city).isNotNull()).groupBy(city).agg(F.count(F.lit(1)).alias("_rows"),
                                                                 F.max("date").alias("_last"))
              .where(F.col("_rows") >= minimum))


def project_covariates(df: DataFrame, horizon: int = 7, city: str = "ville") -> DataFrame:
    """For every city with >= 14 rows and every projection column,
    next = bound(last non-missing + D7 slope of the last 14 non-missing
    values), fed back recursively.  Returns (city, colonne, pas, valeur)."""
    cols = projection_columns(df)
    cities = eligible_cities(df, city)
    grid = cities.select(city, F.explode(F.array(*[F.lit(c) for c in cols])).alias("colonne"))
    vals = recent_values(df.join(cities.select(city), city, "left_semi"), cols, city)
    g = (grid.join(vals, [city, "colonne"], "left")
             .withColumn("_arr", F.coalesce(F.col("_arr"), F.expr("cast(array() as array<double>)")))
             .withColumn("_rule", _rule_expr(cols)))
    base = "(CASE WHEN size(st.s) > 0 THEN element_at(st.s, size(st.s)) ELSE 0D END)"
    nv = _bound_sql(f"({base} + {slope_sql('st.s')})")
    # state s: the last <= 14 values (oldest first); o: the projected values
    fold = (f"aggregate(sequence(1, {int(horizon)}), named_struct('s', _arr, 'o', cast(array() as array<double>)), "
            f"(st, i) -> named_struct('s', slice(concat(st.s, array({nv})), greatest(size(st.s) - 12, 1), 14), "
            f"'o', concat(st.o, array({nv}))), st -> st.o)")
    return g.select(city, "colonne", F.posexplode(F.expr(fold)).alias("_k", "valeur")) \
            .select(city, "colonne", (F.col("_k") + 1).alias("pas"), "valeur")


# --- J4: future feature rows ------------------------------------------------------

def future_features(df: DataFrame, horizon: int = 7, city: str = "ville") -> DataFrame:
    """One row per (city, future day): calendar parts of date + k,
    season by G14 (month mode, else last known, else overall mode),
    projected covariates (J3) pivoted back with fixed column values,
    B3-B9 recomputed, lag 1 / lag 7 / trailing 7-row mean over the history
    tail U projected rows, everything else carried from the last row."""
    from envspark.operators.rollups import season_by_month
    cols = projection_columns(df)
    cities = eligible_cities(df, city)
    hist = df.join(cities.select(city), city, "left_semi")
    ranked = last_k(hist, [city], [F.col("date").desc_nulls_last(), F.col("identifiant").desc()],
                    C.TRAILING_ROWS, F.coalesce(F.year("date"), F.lit(-1)))
    last_row = ranked.where(F.col("_rn") == 1).drop("_rn")
    proj = project_covariates(df, horizon, city)
    wide = proj.groupBy(city, "pas").pivot("colonne", cols).agg(F.first("valeur"))
    carried = [c for c in df.columns if c not in cols and c != city]
    fut = (last_row.select(city, *[F.col(c).alias(f"__last_{c}") for c in carried], F.col("date").alias("_d"))
           .join(wide, city))
    d = F.date_add(F.col("_d"), F.col("pas").cast("int"))
    fut = fut.select(city, "pas", *cols, d.alias("date"),
                     *[F.col(f"__last_{c}").alias(c) for c in carried if c != "date"])
    cal = {"annee": F.year("date"), "mois": F.month("date"), "jour_annee": F.dayofyear("date")}
    if "trimestre" in df.columns:
        cal["trimestre"] = F.quarter("date")
    if "jour_semaine" in df.columns:
        cal["jour_semaine"] = F.weekday("date")
    fut = fut.withColumns(cal)
    if "saison" in df.columns:
        sm = season_by_month(hist)
        months = sm.select(city, "mois", "saison_mois")
        fb = sm.select(city, "saison_derniere", "saison_mode").dropDuplicates([city])
        fut = (join_keys(fut, months, [city, "mois"], "left")
                  .join(fb, city, "left")
                  .withColumn("saison", F.coalesce("saison_mois", "saison_derniere", "saison_mode"))
                  .drop("saison_mois", "saison_derniere", "saison_mode"))
    derived = features.derived_expressions(cols + ["mois"])
    derived = {k: v for k, v in derived.items() if k in df.columns}
    fut = fut.withColumns(derived)
    # lags over history tail (7 rows) U projected rows
    lag_vars = [c for c in C.LAG_VARS if c in df.columns]
    tail = (ranked.where(F.col("_rn") <= C.TRAILING_ROWS)
                  .select(city, "date", *lag_vars, F.lit(0).alias("pas")))
    seq = tail.unionByName(fut.select(city, "date", *lag_vars, "pas"))
    w = Window.partitionBy(city).orderBy("date", "pas")
    lagged = {}
    for c in lag_vars:
        lagged[f"{c}_lag1"] = F.lag(c, 1).over(w)
        lagged[f"{c}_lag7"] = F.lag(c, 7).over(w)
        lagged[f"{c}_moy7j"] = F.avg(c).over(w.rowsBetween(-C.TRAILING_ROWS, -1))
    lagged = {k: v for k, v in lagged.items() if k in df.columns}
    lags = seq.withColumns(lagged).where(F.col("pas") > 0).select(city, "pas", *lagged.keys())
    fut = fut.drop(*lagged.keys()).join(lags, [city, "pas"])
    return fut.select(*[c for c in df.columns if c in fut.columns], "pas")


def worst_days(forecast: DataFrame, k: int = 3, city: str = "ville") -> DataFrame:
    """The k highest predictions per city (ties -> earlier date)."""
    w = Window.partitionBy(city).orderBy(F.col("prediction").desc_nulls_last(), F.col("date"))
    return forecast.withColumn("rang", F.row_number().over(w)).where(F.col("rang") <= k)
