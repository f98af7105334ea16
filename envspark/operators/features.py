"""B. Calendar / cyclic / derived projections and D1-D3 per-city windows.

All lag and trailing-mean columns share ONE window specification, so the
physical plan has a single shuffle by city, a single sort and one
``Window`` node for the 15 columns.

Scale: the shared window is split per (city, year) with a halo of the
preceding rows, so even a city holding a third of all rows is processed by
one task per year, with values identical to the per-city window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envspark import config as C
from envspark.functions.exprs import to_number
from envspark.functions.windows import halo_window_columns


def city_order_window(city: str = "ville", order_key: str | None = "identifiant"):
    """Canonical order inside a city: date ascending (missing last), then
    the row key as tie-breaker (T23)."""
    keys = [F.col("date").asc_nulls_last()]
    if order_key:
        keys.append(F.col(order_key).asc_nulls_last())
    return Window.partitionBy(city).orderBy(*keys)


def with_calendar(df: DataFrame) -> DataFrame:
    """B1: year and month only if absent (month is coerced), day of year."""
    d = F.col("date")
    out = {}
    if "annee" not in df.columns:
        out["annee"] = F.year(d)
    out["mois"] = F.month(d) if "mois" not in df.columns else to_number("mois").cast("int")
    out["jour_annee"] = F.dayofyear(d)
    return df.withColumns(out)


def month_cyclic(m: Column) -> tuple[Column, Column]:
    a = F.lit(2 * math.pi) * m / F.lit(12.0)
    return F.sin(a), F.cos(a)


def wind_cyclic(deg: Column) -> tuple[Column, Column]:
    r = F.radians(deg)
    return F.sin(r), F.cos(r)


def derived_expressions(cols: Sequence[str]) -> dict[str, Column]:
    """B3-B9 expressions, each only when its inputs exist."""
    have = set(cols)
    out: dict[str, Column] = {}
    if "mois" in have:
        out["mois_sin"], out["mois_cos"] = month_cyclic(F.col("mois"))
    if "direction_vent" in have:
        out["vent_sin"], out["vent_cos"] = wind_cyclic(F.col("direction_vent"))
    if {"temp_moy", "point_rosee_moy"} <= have:
        out["ecart_point_rosee"] = F.col("temp_moy") - F.col("point_rosee_moy")
    if {"rafales_max", "vitesse_vent_max"} <= have:
        out["ratio_rafales"] = F.try_divide(F.col("rafales_max"), F.col("vitesse_vent_max") + F.lit(0.1))
    if "pression_mer_moy" in have:
        out["pression_anomalie"] = F.col("pression_mer_moy") - F.lit(1013.25)
    if {"temp_max", "ressenti_max"} <= have:
        out["ecart_ressenti"] = F.col("temp_max") - F.col("ressenti_max")
    if {"duree_ensoleillement", "duree_jour"} <= have:
        out["ratio_ensoleillement"] = F.try_divide(F.col("duree_ensoleillement"),
                                                   F.col("duree_jour") + F.lit(0.01))
    return out


def add_derived(df: DataFrame) -> DataFrame:
    """B3-B9 on a DataFrame (month/wind cyclic, gaps and ratios)."""
    exprs = derived_expressions(df.columns)
    return df.withColumns(exprs) if exprs else df


def lag_window_columns(w, vars_: Sequence[str], lags: Sequence[int] = C.LAGS, rows: int = C.TRAILING_ROWS,
                       city: str = "ville") -> dict[str, Column]:
    """D2 + D3 expressions over one shared window (row based, T11/T12).

    Rows whose city is missing get missing values (pandas drops NULL keys
    from group-by; Spark would group them together)."""
    has_city = F.col(city).isNotNull()
    out: dict[str, Column] = {}
    for k in lags:
        for c in vars_:
            out[f"{c}_lag{k}"] = F.when(has_city, F.lag(c, k).over(w))
    trailing = w.rowsBetween(-rows, -1)
    for c in vars_:
        out[f"{c}_moy7j"] = F.when(has_city, F.avg(c).over(trailing))
    return out


def add_lags_and_trailing(df: DataFrame, lag_vars: Sequence[str] = C.LAG_VARS, lags: Sequence[int] = C.LAGS,
                          rows: int = C.TRAILING_ROWS, city: str = "ville",
                          order_key: str | None = "identifiant") -> DataFrame:
    """D1-D3.  Every city is windowed per range of days with a halo of the
    preceding rows (``functions.windows``): the values of the per-city window,
    in as many tasks as the city's share of the rows asks for."""
    vars_ = [c for c in lag_vars if c in df.columns]
    if city not in df.columns or not vars_:
        return df
    okey = order_key if order_key and order_key in df.columns else None
    order = ["date"] + ([okey] if okey else [])
    return halo_window_columns(df, city, order, vars_, max(max(lags), rows),
                               lambda w: lag_window_columns(w, vars_, lags, rows, city))
