"""Observation preparation plan.

source -> rename (A3) -> drop (A2) -> parse (A4/A5) -> calendar (B1) ->
units (A6) -> cyclic/derived (B3-B9) -> lags/trailing means (D1-D3, one
window) -> [lineage cut] -> index fit on training years (E1) -> proxy,
stagnation, risk (E2, E5, E6) -> Q80 threshold (E3) -> flag (E4) -> level
(F1) -> [lineage cut].

The lineage cuts write Parquet tables into the shared
``spark.checkpoint.dir`` (``session.materialize``): the plan runs once, the
files survive executor loss, and later scans prune columns and, for slices of
the prepared table (partitioned by year), partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark import config as C
from envspark.functions.exprs import level_expr
from envspark.operators import cleaning, features, index
from envspark.session import materialize, one_row
from envspark.sources.observations import observations_from_orders


@dataclass
class Prepared:
    obs: DataFrame          # prepared observation table
    params: DataFrame       # one row: cutoff, index bounds, duration medians, seuil


def clean_observations(raw: DataFrame) -> DataFrame:
    """A1-A5 on a source-named table: rename, drop, parse, NaN -> NULL."""
    df = cleaning.rename_columns(raw)
    df = cleaning.drop_columns(df, keep=("identifiant",))
    df = cleaning.parse_dates(df)
    return cleaning.normalize_numeric(df, cols=["mois"] + C.DURATION_COLS)


def featurize(df: DataFrame) -> DataFrame:
    """B1, A6, B3-B9, D1-D3."""
    df = features.with_calendar(df)
    df = cleaning.seconds_to_hours(df)
    df = features.add_derived(df)
    return features.add_lags_and_trailing(df)


def add_index(df: DataFrame, opts: C.PrepareOptions | None = None,
              cut_lineage: bool = False) -> tuple[DataFrame, DataFrame]:
    """E1-E6 + F1.  With ``cut_lineage`` each one-row parameter table is
    written once and the later steps read it, so the index fit and the
    threshold are not recomputed by the final write."""
    opts = opts or C.PrepareOptions()
    params = index.fit_index(df, opts.test_years)
    if cut_lineage:
        params = one_row(materialize(params, "index_params"))
    scored = index.apply_index(df, params)
    train = scored.where(F.col("annee") <= F.col("cutoff"))
    thr = index.fit_threshold(train, opts.alert_quantile)
    if cut_lineage:
        thr = one_row(materialize(thr, "alert_threshold"))
    out = (scored.crossJoin(F.broadcast(thr))
           .withColumn("alerte_pollution", index.alert_flag(F.col("proxy_pm25"), F.col("seuil")))
           .withColumn("niveau_alerte", level_expr(F.col("proxy_pm25"), C.target_config("proxy_pm25")))
           .withColumnsRenamed({"cutoff": "_cutoff", "seuil": "_seuil"}))
    return out, params.crossJoin(thr)


def prepare(raw: DataFrame, opts: C.PrepareOptions | None = None, cut_lineage: bool = True) -> Prepared:
    spark = raw.sparkSession
    clean = clean_observations(raw)
    if cut_lineage:
        # the source (star-schema adapter) is computed once; the global fits
        # below (unit medians, index bounds, threshold) scan the written table
        clean = materialize(clean, "observations_clean")
    feat = featurize(clean)
    if cut_lineage:
        feat = materialize(feat, "observations_features")
    obs, params = add_index(feat, opts, cut_lineage)
    if cut_lineage:
        obs = materialize(obs, "observations_prepared", partition_by=["annee"])
    return Prepared(obs, params)


def prepared_observations(spark: SparkSession, sf_dir: str, cut_lineage: bool = True) -> Prepared:
    return prepare(observations_from_orders(spark, sf_dir), cut_lineage=cut_lineage)
