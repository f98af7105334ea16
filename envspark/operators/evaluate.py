"""L. Evaluation: regression and classification metrics, ROC-AUC and ROC
points (tie-aware), confusion matrix, sub-group evaluation, comparison
table, predicted-vs-actual.

All metrics are sums computed in ONE aggregate pass (plus a one-row mean
for R2).  ROC quantities need cumulative counts over the distinct scores;
they are computed with a distributed prefix sum: scores are grouped first
(a hot score becomes one row with counts), split into value ranges by
approximate quantiles, each range gets its offset from a tiny per-range
table, and the cumulative sum runs inside each range.  No single-partition
window over the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envspark import config as C
from envspark.functions.joins import join_keys
from envspark.functions.quantiles import cumulative_counts
from envspark.functions.windows import halo_window_columns


def scored_persistence(obs: DataFrame, target: str = "proxy_pm25", test_only: bool = True) -> DataFrame:
    """Deterministic baseline predictor (persistence): the previous row's
    value of the same city in canonical order.  Gives a scored-predictions
    table (FIXTURES 1b) for the evaluation operators without ML.
    Regression: prediction = previous proxy.  Classification columns:
    ``alerte_pred`` = previous flag, ``score_prediction`` = previous proxy / 100."""
    def build(w):
        return {"prediction": F.when(F.col("ville").isNotNull(), F.lag(target, 1).over(w)),
                "alerte_pred": F.when(F.col("ville").isNotNull(), F.lag("alerte_pollution", 1).over(w))}
    cut = obs.agg(F.max("_cutoff")).first()[0] if test_only else None
    if cut is not None:
        # the test years, and of the earlier ones (in few columns) each city's last row
        cols = ["identifiant", "date", "ville", "region", "saison", "annee", target, "alerte_pollution"]
        latest = F.max_by(F.struct(*cols), F.struct("date", "identifiant"))
        earlier = obs.where(F.col("annee") <= cut).groupBy(F.col("ville").alias("_v")).agg(latest.alias("_r")).select("_r.*")
        obs = obs.where(F.col("annee") > cut).select(*cols).unionByName(earlier)
    # per range of days with a one-row halo: a hot city is split
    d = halo_window_columns(obs, "ville", ["date", "identifiant"], [target, "alerte_pollution"], 1, build)
    d = d.withColumn("score_prediction", F.col("prediction") / F.lit(100.0))
    if cut is not None:
        d = d.where(F.col("annee") > cut)
    return d.where(F.col(target).isNotNull() & F.col("prediction").isNotNull()).select(
        "date", "ville", "region", "saison", "annee", target, "prediction",
        "alerte_pollution", "alerte_pred", "score_prediction")


def _r2(sse: Column, sst: Column) -> Column:
    return (F.when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
             .otherwise(F.lit(1.0) - sse / sst))


def regression_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """L1 (and per group for L6): R2 = 1 - SSE/SST (sklearn convention when
    SST = 0), RMSE, MAE in one pass: SST is n times the population variance,
    which Spark merges from central moments."""
    keys = list(by)
    d = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()) \
        .select(*keys, F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_p"))
    err = F.col("_y") - F.col("_p")
    agg = [F.count(F.lit(1)).alias("n"), F.sum(err * err).alias("_sse"), F.var_pop("_y").alias("_var"),
           F.avg(F.abs(err)).alias("MAE"), (F.min("_y") == F.max("_y")).alias("_flat")]
    g = d.groupBy(*keys).agg(*agg) if keys else d.agg(*agg)
    sst = F.when(F.col("_flat"), F.lit(0.0)).otherwise(F.col("_var") * F.col("n"))
    return g.select(*keys, "n", _r2(F.col("_sse"), sst).alias("R2"),
                    F.sqrt(F.col("_sse") / F.col("n")).alias("RMSE"), "MAE")


def _safe(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0))), F.lit(0.0))


def classification_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """L2: accuracy, F1, precision, recall; zero division -> 0."""
    d = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    yy, pp = F.col(y).cast("int"), F.col(p).cast("int")
    agg = [F.count(F.lit(1)).alias("n"),
           F.count_if(yy == pp).alias("_ok"),
           F.count_if((yy == 1) & (pp == 1)).alias("_tp"),
           F.count_if((yy == 0) & (pp == 1)).alias("_fp"),
           F.count_if((yy == 1) & (pp == 0)).alias("_fn")]
    keys = list(by)
    g = d.groupBy(*keys).agg(*agg) if keys else d.agg(*agg)
    prec = _safe(F.col("_tp"), F.col("_tp") + F.col("_fp"))
    rec = _safe(F.col("_tp"), F.col("_tp") + F.col("_fn"))
    f1 = _safe(2 * F.col("_tp"), 2 * F.col("_tp") + F.col("_fp") + F.col("_fn"))
    return g.select(*keys, "n", (F.col("_ok") / F.col("n")).alias("Accuracy"), f1.alias("F1"),
                    prec.alias("Precision"), rec.alias("Recall"))


def _score_counts(df: DataFrame, y: str, s: str, by: Sequence[str]) -> DataFrame:
    d = df.where(F.col(y).isNotNull() & F.col(s).isNotNull())
    return d.groupBy(*by, F.col(s).cast("double").alias("_s")).agg(
        F.count_if(F.col(y).cast("int") == 1).alias("_pos"),
        F.count_if(F.col(y).cast("int") != 1).alias("_neg"))


def cumulative_by_score(counts: DataFrame, by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Distributed prefix sums of _pos/_neg over the distinct scores ``_s``
    (see ``functions.quantiles.cumulative_counts``): adds ``_cpos``/``_cneg``,
    the totals over scores strictly before this one."""
    return cumulative_counts(counts, "_s", ["_pos", "_neg"], by, descending)


def roc_auc(df: DataFrame, y: str, s: str, by: Sequence[str] = ()) -> DataFrame:
    """L3: Mann-Whitney AUC with ties counted half; NULL unless both classes occur."""
    keys = list(by)
    cum = cumulative_by_score(_score_counts(df, y, s, keys), keys)
    contrib = F.col("_pos") * (F.col("_c_neg") + F.col("_neg") / F.lit(2.0))
    agg = [F.sum(contrib).alias("_u"), F.sum("_pos").alias("_tot_pos"), F.sum("_neg").alias("_tot_neg")]
    g = cum.groupBy(*keys).agg(*agg) if keys else cum.agg(*agg)
    return g.select(*keys, F.when((F.col("_tot_pos") > 0) & (F.col("_tot_neg") > 0),
                                  F.col("_u") / (F.col("_tot_pos") * F.col("_tot_neg"))).alias("ROC_AUC"))


def roc_points(df: DataFrame, y: str, s: str) -> DataFrame:
    """L4: one point per distinct score (threshold), descending: TPR and FPR
    of the rule score >= threshold."""
    counts = _score_counts(df, y, s, [])
    cum = cumulative_by_score(counts, [], descending=True)
    tot = counts.agg(F.sum("_pos").alias("_tot_pos"), F.sum("_neg").alias("_tot_neg"))
    j = cum.crossJoin(F.broadcast(tot))
    return j.select(F.col("_s").alias("seuil"),
                    ((F.col("_c_pos") + F.col("_pos")) / F.col("_tot_pos")).alias("tpr"),
                    ((F.col("_c_neg") + F.col("_neg")) / F.col("_tot_neg")).alias("fpr"))


def confusion_matrix(df: DataFrame, y: str, p: str) -> DataFrame:
    """2x2 counts (zero cells kept) over a fixed 2x2 label grid."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in (0, 1) for b in (0, 1)], "reel int, predit int")
    c = (df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
           .groupBy(F.col(y).cast("int").alias("reel"), F.col(p).cast("int").alias("predit"))
           .agg(F.count(F.lit(1)).alias("n")))
    return (F.broadcast(grid).join(c, ["reel", "predit"], "left")
            .select("reel", "predit", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def evaluate_groups(df: DataFrame, task: str, y: str, p: str, score: str | None = None,
                    group_cols: Sequence[str] = ("region", "ville"),
                    min_rows: int = C.MIN_GROUP_ROWS) -> DataFrame:
    """Metrics per sub-group for each grouping column (missing key kept),
    groups with fewer than ``min_rows`` rows dropped; stacked with
    ``unionByName`` and tagged by grouping column."""
    out = None
    for g in group_cols:
        if g not in df.columns:
            continue
        d = df.withColumn("groupe", F.col(g).cast("string"))
        if task == "classification":
            m = classification_metrics(d, y, p, ["groupe"])
            if score:
                auc = roc_auc(d, y, score, ["groupe"]).withColumnRenamed("groupe", "_g")
                m = m.join(auc, F.col("groupe").eqNullSafe(F.col("_g")), "left").drop("_g")
        else:
            m = regression_metrics(d, y, p, ["groupe"])
        m = m.where(F.col("n") >= min_rows).withColumn("groupement", F.lit(g))
        out = m if out is None else out.unionByName(m)
    return out


def comparison_table(results: DataFrame, task: str) -> DataFrame:
    """Model, seconds (3 decimals), metrics, sorted by the key metric,
    best flagged (first wins ties), verdict from the fixed thresholds."""
    key = "F1" if task == "classification" else "R2"
    rules = C.VERDICT_CLASSIFICATION if task == "classification" else C.VERDICT_REGRESSION
    verdict = None
    for thr, text in rules:
        cond = F.col(key) > F.lit(thr)
        verdict = F.when(cond, F.lit(text)) if verdict is None else verdict.when(cond, F.lit(text))
    best = best_result(results, key).select(F.col("ordre").alias("_best"))          # one row
    return (results.crossJoin(F.broadcast(best))
            .withColumn("temps_secondes", F.round(F.col("temps_secondes"), 3))
            .withColumn("meilleur", F.coalesce(F.col("ordre") == F.col("_best"), F.lit(False))).drop("_best")
            .withColumn("verdict", verdict.otherwise(F.lit("")))
            .orderBy(F.col(key).desc_nulls_last(), F.col("ordre")))


def best_result(results: DataFrame, key: str) -> DataFrame:
    """One row (``ordre``, ``modele``, ``score``) of the candidate with the
    largest key metric; the first in comparison order wins ties; a candidate
    without the metric is never chosen (no row then: all NULL)."""
    place = F.when(F.col(key).isNotNull(), F.struct(F.col(key), -F.col("ordre")))
    return results.agg(F.max_by(F.struct("ordre", "modele", F.col(key).alias("score")), place).alias("_r")).select("_r.*")


def residuals(df: DataFrame, y: str, p: str) -> DataFrame:
    """Actual, prediction and residual = actual - prediction."""
    return df.withColumn("residu", F.col(y).cast("double") - F.col(p).cast("double"))
