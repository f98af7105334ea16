"""E. Fitted composite index.

Fitting is a single global aggregate over the training rows that yields a
ONE-ROW parameter table; applying it is a broadcast cross join (size bound:
one row) plus a projection, so the whole index stays inside whole-stage
codegen and nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envspark import config as C
from envspark.functions.exprs import clip01
from envspark.functions.quantiles import exact_quantiles


def fit_cutoff(df: DataFrame, test_years: int = C.TEST_YEARS) -> DataFrame:
    """C3 fit: cutoff = max(year) - test_years (one row)."""
    return df.agg((F.max("annee") - F.lit(test_years)).alias("cutoff"))


def radiation_column(cols: Sequence[str]) -> str | None:
    """The radiation input is chosen per column: solar radiation if present,
    else shortwave total (not a row-level coalesce)."""
    for c in C.RADIATION_COLS:
        if c in cols:
            return c
    return None


def index_inputs(cols: Sequence[str]) -> dict[str, Column]:
    """The raw inputs of the proxy, keyed by parameter name."""
    out: dict[str, Column] = {}
    have = set(cols)
    for name, _, _ in C.PROXY_TERMS:
        if name == "__radiation__":
            r = radiation_column(cols)
            if r:
                out[r] = F.col(r)
        elif name in have:
            out[name] = F.log1p(F.col(name)) if name == "precipitation" else F.col(name)
    return out


def fit_minmax(train: DataFrame, inputs: dict[str, Column]) -> DataFrame:
    """E1 fit: min and max of each input over the training rows (one row)."""
    aggs = []
    for name, x in inputs.items():
        aggs += [F.min(x).cast("double").alias(f"{name}__min"), F.max(x).cast("double").alias(f"{name}__max")]
    return train.agg(*aggs)


def minmax01(x: Column, name: str) -> Column:
    """E1 apply: (x - min)/(max - min) clipped to [0, 1]; a constant or
    all-missing training range gives 0.5 for every row, even a missing one
    (T3); otherwise missing stays missing (T2)."""
    lo, hi = F.col(f"{name}__min"), F.col(f"{name}__max")
    d = hi - lo
    return F.when(d.isNull() | (d == 0), F.lit(0.5)).otherwise(clip01((x - lo) / d))


def proxy_expr(cols: Sequence[str]) -> Column:
    """100 * weighted sum; an absent input column omits its term; a
    missing value makes the whole index missing (T4)."""
    inputs = index_inputs(cols)
    total = None
    for name, w, inverted in C.PROXY_TERMS:
        key = radiation_column(cols) if name == "__radiation__" else name
        if key is None or key not in inputs:
            continue
        s = minmax01(inputs[key], key)
        term = F.lit(w) * ((F.lit(1.0) - s) if inverted else s)
        total = term if total is None else total + term
    return (total if total is not None else F.lit(0.0)) * F.lit(100.0)


def stagnation_expr(cols: Sequence[str]) -> Column | None:
    """E5: 100 * (0.6 (1 - wind) + 0.4 (1 - boundary layer)), both required."""
    names = [n for n, _ in C.STAGNATION_TERMS]
    if not set(names) <= set(cols):
        return None
    (a, wa), (b, wb) = C.STAGNATION_TERMS
    return (F.lit(wa) * (F.lit(1.0) - minmax01(F.col(a), a))
            + F.lit(wb) * (F.lit(1.0) - minmax01(F.col(b), b))) * F.lit(100.0)


def fit_index(df: DataFrame, test_years: int = C.TEST_YEARS) -> DataFrame:
    """E1 over the training years only: one row with cutoff and the bounds."""
    cut = fit_cutoff(df, test_years)
    train = df.crossJoin(F.broadcast(cut)).where(F.col("annee") <= F.col("cutoff"))
    bounds = fit_minmax(train, index_inputs(df.columns))
    return cut.crossJoin(bounds)


def apply_index(df: DataFrame, params: DataFrame) -> DataFrame:
    """E2, E5, E6 with the fitted one-row params (broadcast)."""
    base_cols = df.columns
    j = df.crossJoin(F.broadcast(params))
    out = {"proxy_pm25": proxy_expr(base_cols)}
    st = stagnation_expr(base_cols)
    if st is not None:
        out["indice_stagnation"] = st
    j = j.withColumns(out).withColumn("score_risque", F.col("proxy_pm25"))
    return j.select(*base_cols, "cutoff", *out.keys(), "score_risque")


def fit_threshold(train: DataFrame, q: float = C.ALERT_QUANTILE, col: str = "proxy_pm25") -> DataFrame:
    """Exact linear-interpolated quantile on the training rows."""
    return exact_quantiles(train, col, [q], names=["seuil"])


def alert_flag(p: Column, threshold: Column) -> Column:
    """1 when proxy >= threshold; a missing proxy gives 0 (T5)."""
    return F.coalesce((p >= threshold).cast("int"), F.lit(0))
