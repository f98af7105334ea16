"""K1-K4: feature preparation fitted on the training rows.

Fitted state is a small DataFrame (one row of medians / means / stds, a
value->code dictionary), joined back by broadcast; its size is bounded by
the number of feature columns or distinct category values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from envspark.functions.quantiles import exact_medians_wide


def fit_medians(train: DataFrame, num_cols: Sequence[str]) -> DataFrame:
    """K1 fit: exact median of each numeric feature on the training rows (one row)."""
    return exact_medians_wide(train, list(num_cols))


def impute(df: DataFrame, medians: DataFrame, num_cols: Sequence[str], default: float | None = None) -> DataFrame:
    """K1 apply: missing -> training median (``default`` when the median itself is missing)."""
    m = medians.select(*[F.col(c).alias(f"__med_{c}") for c in num_cols])
    j = df.crossJoin(F.broadcast(m))
    out = {}
    for c in num_cols:
        med = F.col(f"__med_{c}") if default is None else F.coalesce(F.col(f"__med_{c}"), F.lit(default))
        out[c] = F.coalesce(F.col(c).cast("double"), med)
    return j.withColumns(out).drop(*[f"__med_{c}" for c in num_cols])


def medians_long(medians: DataFrame, num_cols: Sequence[str]) -> DataFrame:
    """K1 params as (feature, median) rows."""
    expr = "stack({n}, {items}) as (feature, median)".format(
        n=len(num_cols), items=", ".join(f"'{c}', `{c}`" for c in num_cols))
    return medians.selectExpr(expr)


def fit_categories(df: DataFrame, cat_cols: Sequence[str]) -> DataFrame:
    """K2 fit: per column, sorted distinct non-missing values of train and
    test (H3 union), code = rank - 1 (T16).  Returns (column, value, code).
    The window is partitioned by column over distinct values only."""
    if not cat_cols:
        return df.sparkSession.createDataFrame([], "column string, value string, code int")
    stack = "stack({n}, {items}) as (column, value)".format(
        n=len(cat_cols), items=", ".join(f"'{c}', cast(`{c}` as string)" for c in cat_cols))
    d = df.select(F.expr(stack)).where("value IS NOT NULL").distinct()
    w = Window.partitionBy("column").orderBy("value")
    return d.withColumn("code", F.row_number().over(w) - 1)


def encode(df: DataFrame, dictionary: DataFrame, cat_cols: Sequence[str]) -> DataFrame:
    """K2 apply: value -> code, missing or unseen -> -1.  The dictionary (one
    entry per distinct category value) becomes one row of maps, and all columns
    are looked up in one projection: no row is shuffled on a category."""
    if not cat_cols:
        return df
    maps = dictionary.agg(*[F.map_from_entries(F.collect_list(F.when(F.col("column") == c, F.struct("value", "code")))).alias(f"__map_{c}")
                            for c in cat_cols])
    j = df.crossJoin(F.broadcast(maps))
    codes = {c: F.coalesce(F.when(F.col(c).isNotNull(), F.try_element_at(F.col(f"__map_{c}"), F.col(c).cast("string"))), F.lit(-1)).cast("int")
             for c in cat_cols}
    return j.withColumns(codes).drop(*[f"__map_{c}" for c in cat_cols])


def fit_scaler(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """K3 fit: mean and population std per feature; zero std -> scale 1."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        sd = F.stddev_pop(x)
        aggs += [F.avg(x).alias(f"{c}__mean"), F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias(f"{c}__scale")]
    return train.agg(*aggs)


def scaler_long(params: DataFrame, cols: Sequence[str]) -> DataFrame:
    expr = "stack({n}, {items}) as (feature, mean, scale)".format(
        n=len(cols), items=", ".join(f"'{c}', `{c}__mean`, `{c}__scale`" for c in cols))
    return params.selectExpr(expr)


def scale(df: DataFrame, params: DataFrame, cols: Sequence[str]) -> DataFrame:
    """K3 apply: (x - mean) / scale as column expressions."""
    j = df.crossJoin(F.broadcast(params))
    j = j.withColumns({c: (F.col(c).cast("double") - F.col(f"{c}__mean")) / F.col(f"{c}__scale") for c in cols})
    return j.drop(*[f"{c}__mean" for c in cols], *[f"{c}__scale" for c in cols])


def encode_for_model(df: DataFrame, feature_cols: Sequence[str], num_cols: Sequence[str],
                     cat_cols: Sequence[str], medians: DataFrame, dictionary: DataFrame) -> DataFrame:
    """K4: add missing feature columns as missing, impute with stored medians
    (0.0 when a median is missing), encode categories (unseen -> -1), keep
    the stored column order."""
    present = set(df.columns)
    add = {c: F.lit(None).cast("double") for c in num_cols if c not in present}
    add.update({c: F.lit(None).cast("string") for c in cat_cols if c not in present})
    d = df.withColumns(add) if add else df
    d = impute(d, medians, num_cols, default=0.0)
    d = encode(d, dictionary, cat_cols)
    keep = [c for c in df.columns if c not in feature_cols]
    return d.select(*keep, *[F.col(c).cast("double").alias(c) for c in feature_cols])
