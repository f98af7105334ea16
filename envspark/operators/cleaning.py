"""A. Sources, schema shaping, cleaning.

Optional columns are resolved once on the driver from ``df.columns`` /
``df.schema`` (metadata only, no job); data-dependent decisions (unit
detection, task type) are one-row aggregates joined back by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envspark import config as C
from envspark.functions.exprs import nan_to_null, parse_date, to_number
from envspark.functions.quantiles import exact_medians_wide, exact_quantiles

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def rename_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """A3: rename by mapping; unknown columns pass through."""
    mapping = C.RENAME if mapping is None else mapping
    present = {k: v for k, v in mapping.items() if k in df.columns and k != v}
    return df.withColumnsRenamed(present) if present else df


def drop_columns(df: DataFrame, names: Sequence[str] | None = None,
                 prefix: str | None = C.DROP_PREFIX, keep: Iterable[str] = ()) -> DataFrame:
    """A2: drop listed columns and any column starting with ``prefix`` if present.

    ``keep`` retains columns the Spark plan still needs (the row key used as
    the last window sort key, trap T23)."""
    names = C.DROP_COLS if names is None else names
    keep = set(keep)
    gone = [c for c in df.columns
            if c not in keep and (c in names or (prefix and c.startswith(prefix)))]
    return df.drop(*gone) if gone else df


def parse_dates(df: DataFrame, col: str = "date") -> DataFrame:
    """A4: coercing date parse."""
    if col not in df.columns:
        return df
    return df.withColumn(col, parse_date(col))


def normalize_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A5 + T1: float columns keep NULL only (NaN -> NULL); listed text
    columns are coerced to double (bad -> NULL)."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = nan_to_null(f.name)
    for c in cols or []:
        if c in df.columns and not isinstance(df.schema[c].dataType, NUMERIC_TYPES):
            out[c] = to_number(c)
    return df.withColumns(out) if out else df


def fit_duration_medians(df: DataFrame, cols: Sequence[str] = C.DURATION_COLS) -> DataFrame:
    """A6 fit: one row with the exact global median of each duration column."""
    present = [c for c in cols if c in df.columns]
    if not present:
        return df.sparkSession.range(1).select()
    nums = df.select(*[to_number(c).alias(c) for c in present])
    return exact_medians_wide(nums, present, suffix="__median")


def seconds_to_hours(df: DataFrame, cols: Sequence[str] = C.DURATION_COLS,
                     limit: float = C.SECONDS_MEDIAN_LIMIT,
                     medians: DataFrame | None = None) -> DataFrame:
    """A duration column is in seconds when its global median exceeds
    ``limit``; then it is divided by 3600 (T24).  The one-row median table is
    broadcast (size bound: one row)."""
    present = [c for c in cols if c in df.columns]
    if not present:
        return df
    med = fit_duration_medians(df, present) if medians is None else medians
    j = df.crossJoin(F.broadcast(med))
    for c in present:
        m = F.col(f"{c}__median")
        j = j.withColumn(c, F.when(m > F.lit(limit), to_number(c) / F.lit(3600.0))
                         .otherwise(to_number(c)))
    return j.drop(*[f"{c}__median" for c in present])


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows where any listed column is missing."""
    return df.dropna(subset=[c for c in cols if c in df.columns])


def audit(df: DataFrame) -> DataFrame:
    """Row count, distinct cities (missing ignored), first and last year."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_distinct("ville").alias("n_cities"),
                  F.min("annee").alias("year_min"),
                  F.max("annee").alias("year_max"))


def describe_exact(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, sample std, min, exact linear quartiles, max."""
    x = F.col(col)
    m = df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
               F.min(x).cast("double").alias("min"), F.max(x).cast("double").alias("max"))
    q = exact_quantiles(df, col, [0.25, 0.5, 0.75], names=["q25", "q50", "q75"])
    return m.crossJoin(q).select("count", "mean", "std", "min", "q25", "q50", "q75", "max")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A10: class counts including the missing value, ordered by value."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.col("value").asc_nulls_last())


def columns_equal(df: DataFrame, a: str, b: str) -> DataFrame:
    """True when the two columns are equal row by row (missing == missing)."""
    return df.agg((F.count_if(~F.col(a).eqNullSafe(F.col(b))) == 0).alias("identical"))


def detect_task_type(df: DataFrame, col: str) -> DataFrame:
    """Classification when the non-missing distinct values are a
    non-empty subset of {0, 1}, else regression (one-row result)."""
    x = F.col(col).cast("double")
    return df.agg(
        F.when((F.count(x) > 0) & F.coalesce(F.bool_and(x.isNull() | x.isin(0.0, 1.0)), F.lit(False)),
               F.lit("classification")).otherwise(F.lit("regression")).alias("task_type"))


def task_type_of(df: DataFrame, col: str) -> str:
    """Driver-side value of A12 (one row) for choosing ML estimators."""
    return detect_task_type(df, col).first()["task_type"]


def select_features(df: DataFrame, target: str, exclude_components: bool = True
                    ) -> tuple[list[str], list[str]]:
    """Numeric features by schema type, minus targets, identifiers and
    (by default, anti-leak) the raw index inputs; categorical features from
    the fixed list.  Pure schema logic: no job."""
    cats = [c for c in C.CAT_COLS if c in df.columns]
    excluded = set(C.ALL_TARGETS) | set(C.EXCLUDED_NON_FEATURES) | {"niveau_alerte"}
    if exclude_components:
        excluded |= set(C.RAW_COMPONENTS)
    nums = [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in excluded
            and f.name not in cats and f.name != target and not f.name.startswith("_")]
    return nums, cats
