"""Distributed model training, comparison, selection,
importance, persistence and model-based forecasts with Spark ML.

Data preparation (K1-K4) stays in DataFrame expressions; only the final
``VectorAssembler`` + estimator run as a Spark ML ``Pipeline``.  Estimator
hyper-parameters that depend on the data (ridge / logistic penalties) need
two scalars (row count, label std); they come from one aggregate row.
Training data is persisted once and reused by every candidate.
"""

from __future__ import annotations

import json
import os
import sys
import time
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark import StorageLevel

from envspark import config as C
from envspark.functions.exprs import clip, level_expr
from envspark.operators import cleaning, evaluate, prep, slices
from envspark.operators.index import alert_flag
from envspark.session import materialize, one_row

SEED = 42
SCALED_MODELS = {"Ridge", "LogisticRegression", "MLP"}


@dataclass
class TrainingData:
    target: str
    task: str
    num_cols: list[str]
    cat_cols: list[str]
    train: DataFrame          # imputed + encoded (+ scaled copies under the same names in train_scaled)
    test: DataFrame
    train_scaled: DataFrame
    test_scaled: DataFrame
    medians: DataFrame
    dictionary: DataFrame
    scaler: DataFrame
    meta_cols: list[str] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return self.num_cols + self.cat_cols


def training_data(obs: DataFrame, target: str = "proxy_pm25", task: str | None = None,
                  exclude_components: bool = True, only: list[str] | None = None) -> TrainingData:
    """A7 + C3 + A13 + K1-K3: rows with a target split by year, features
    imputed with training medians, categories coded, scaled copies for the
    linear and neural models.  ``only`` names the features to use."""
    d = cleaning.drop_missing(obs, [target])
    task = task or cleaning.task_type_of(d, target)
    num_cols, cat_cols = cleaning.select_features(d, target, exclude_components)
    if only:
        kinds = {f.name: isinstance(f.dataType, T.StringType) for f in d.schema.fields}
        num_cols, cat_cols = [c for c in only if not kinds[c]], [c for c in only if kinds[c]]
    cut = slices.year_cutoff(d)
    side = F.lit(None).cast("string") if cut is None else F.when(F.col("annee") <= cut, "train").when(F.col("annee") > cut, "test")
    split = d.where(F.col("annee").isNotNull()).withColumn("split", side)
    meta = [c for c in ["date", "ville", "region", "saison", "annee"] if c in d.columns]
    label = F.col(target).cast("int" if task == "classification" else "double").alias("label")
    key = [F.col("identifiant").alias("_m_identifiant")] if "identifiant" in d.columns else []
    base = split.where(F.col("split").isNotNull()).select(
        *[F.col(c).alias(f"_m_{c}") for c in meta], *key, *num_cols, *cat_cols, label, "split")
    tr = slices.train_rows(d, cut).select(*num_cols)
    # fitted tables and the encoded rows are written once; every candidate reads them
    medians = one_row(materialize(prep.fit_medians(tr, num_cols), "medians"))
    dictionary = materialize(prep.fit_categories(base, cat_cols), "categories")  # train U test (H3)
    enc = prep.encode(prep.impute(base, medians, num_cols), dictionary, cat_cols)
    enc = enc.select(*[F.col(c) for c in enc.columns if c not in num_cols + cat_cols],
                     *[F.col(c).cast("double").alias(c) for c in num_cols + cat_cols])
    enc = materialize(enc, "encoded", partition_by=["split"])
    tr_enc = enc.where(F.col("split") == "train")
    scaler = one_row(materialize(prep.fit_scaler(tr_enc, num_cols + cat_cols), "scaler"))
    sc = prep.scale(enc, scaler, num_cols + cat_cols)
    return TrainingData(target, task, num_cols, cat_cols,
                        tr_enc, enc.where(F.col("split") == "test"),
                        sc.where(F.col("split") == "train"), sc.where(F.col("split") == "test"),
                        medians, dictionary, scaler, meta)


def candidates(task: str, n_features: int, n_train: int, label_std: float) -> list[tuple[str, object]]:
    """K5-K9: the candidate estimators, in comparison order."""
    if task == "classification":
        return [
            ("LogisticRegression", LogisticRegression(regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                                                      standardization=False, maxIter=1000)),
            ("GBT", GBTClassifier(maxIter=200, stepSize=0.05, maxDepth=6, subsamplingRate=0.8,
                                  featureSubsetStrategy="0.8", seed=SEED)),
            ("RandomForest", RandomForestClassifier(numTrees=200, maxDepth=6, subsamplingRate=0.8,
                                                    featureSubsetStrategy="0.8", seed=SEED)),
            ("MLP", MultilayerPerceptronClassifier(layers=[n_features, 64, 32, 2], maxIter=200, seed=SEED)),
        ]
    return [
        ("Ridge", LinearRegression(solver="normal", elasticNetParam=0.0, standardization=False,
                                   regParam=1.0 * label_std / max(n_train, 1))),
        ("GBT", GBTRegressor(maxIter=200, stepSize=0.05, maxDepth=6, subsamplingRate=0.8,
                             featureSubsetStrategy="0.8", seed=SEED)),
        ("RandomForest", RandomForestRegressor(numTrees=200, maxDepth=6, subsamplingRate=0.8,
                                               featureSubsetStrategy="0.8", seed=SEED)),
    ]


PATIENCE = 20


def early_stopped_booster() -> GBTRegressor:
    """120 rounds, rate 0.06, 0.85 sampling."""
    return GBTRegressor(maxIter=120, stepSize=0.06, maxDepth=6, subsamplingRate=0.85, featureSubsetStrategy="0.85", seed=SEED)


def stop_rule(curve: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """A validation curve (``tour``, ``perte``; one row per round) with the
    best round so far (``meilleur_tour``, the first of equals), the rounds since
    (``sans_gain``), whether training has stopped (``arrete``: ``patience``
    rounds without a smaller loss) and whether the round's tree is kept
    (``garde``: up to the best round before the stop)."""
    upto = Window.orderBy("tour").rowsBetween(Window.unboundedPreceding, Window.currentRow)     # one row per round
    before = Window.orderBy("tour").rowsBetween(Window.unboundedPreceding, -1)
    c = curve.withColumn("_lead", F.coalesce(F.col("perte") < F.min("perte").over(before), F.lit(True)))
    c = c.withColumn("meilleur_tour", F.max(F.when(F.col("_lead"), F.col("tour"))).over(upto))
    c = c.withColumn("sans_gain", F.col("tour") - F.col("meilleur_tour"))
    c = c.withColumn("arrete", F.max(F.col("sans_gain") >= patience).over(upto))
    # the first round that stops shows the same best round as all rounds before it
    kept = F.coalesce(F.min(F.when(F.col("arrete"), F.col("meilleur_tour"))).over(Window.partitionBy()), F.max("meilleur_tour").over(Window.partitionBy()))
    return c.withColumn("garde", F.col("tour") <= kept).drop("_lead")


def cut_booster(model: PipelineModel, rounds: int) -> PipelineModel:
    """The model of the first ``rounds`` boosting rounds."""
    gbt = model.stages[-1]
    if rounds >= gbt.getNumTrees:
        return model
    java, gateway = gbt._java_obj, SparkSession.active().sparkContext._gateway
    trees, weights = java.trees(), java.treeWeights()
    first = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    share = gateway.new_array(gateway.jvm.double, rounds)
    for i in range(rounds):
        first[i], share[i] = trees[i], weights[i]
    cut = gateway.jvm.org.apache.spark.ml.regression.GBTRegressionModel(java.uid(), first, share, java.numFeatures())
    return PipelineModel([*model.stages[:-1], GBTRegressionModel(cut)])


@dataclass
class EarlyStopped:
    model: PipelineModel
    curve: DataFrame          # rows of ``stop_rule``; empty where nothing validates
    rounds: int               # trees kept
    predictions: DataFrame


def fit_early_stopped(td: TrainingData, fraction: float = 0.85, min_validation: int = 20, patience: int = PATIENCE) -> EarlyStopped:
    """K10 + C4: the booster is trained on the fit rows of the positional
    validation split, its loss on the validation rows is taken after every
    round, and the model is cut to the best round before ``patience`` rounds
    without gain.  Where no more than ``min_validation`` rows would validate, it
    trains on all training rows without stopping."""
    tr = td.train.select("*", F.col("_m_ville").alias("ville"), F.col("_m_date").alias("date"),
                         F.col("_m_identifiant").alias("identifiant"))
    split = materialize(slices.validation_split(tr, fraction, min_validation), "validation-split")
    spark = split.sparkSession
    n = split.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_validation").alias("v")).first()
    parts = training_partitions(n["n"] - n["v"], len(td.features), spark.sparkContext.defaultParallelism)
    fit = split.where("NOT is_validation").repartition(parts).persist(StorageLevel.MEMORY_AND_DISK)
    model = _pipeline(td.features, early_stopped_booster()).fit(fit)
    fit.unpersist()
    losses: list[float] = []
    if n["v"]:
        held = model.stages[0].transform(split.where("is_validation")).select("features", "label")
        losses = model.stages[-1].evaluateEachIteration(held, "squared")
    curve = stop_rule(spark.createDataFrame([(i, float(x)) for i, x in enumerate(losses, 1)], "tour int, perte double"), patience)
    rounds = curve.where("garde").count() if losses else model.stages[-1].getNumTrees
    model = cut_booster(model, rounds)
    return EarlyStopped(model, curve, rounds, score(model, td.test, td.task))


@dataclass
class RunResult:
    name: str
    model: PipelineModel
    scaled: bool
    predictions: DataFrame
    metrics: dict
    seconds: float


def _pipeline(features: list[str], est) -> Pipeline:
    asm = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[asm, est])


def score(model: PipelineModel, df: DataFrame, task: str) -> DataFrame:
    out = model.transform(df)
    if task == "classification":
        out = out.withColumn("score_prediction", vector_to_array("probability")[1]) \
                 .withColumn("prediction", F.col("prediction").cast("int"))
    return out.drop("features", "rawPrediction", "probability")


def metrics_of(pred: DataFrame, task: str) -> dict:
    """L1/L2/L3 on the scored test rows (one small aggregate each)."""
    if task == "classification":
        m = evaluate.classification_metrics(pred, "label", "prediction").first().asDict()
        auc = evaluate.roc_auc(pred, "label", "score_prediction").first()["ROC_AUC"]
        out = {k: m[k] for k in ("Accuracy", "F1", "Precision", "Recall")}
        if auc is not None:
            out["ROC-AUC"] = auc
        return out
    m = evaluate.regression_metrics(pred, "label", "prediction").first().asDict()
    return {k: m[k] for k in ("R2", "RMSE", "MAE")}


TRAINING_PARTITION_BYTES = 128 << 20
FEWEST_ROWS = 5_000


def training_partitions(n_rows: int, n_features: int, width: int) -> int:
    """Iterative learners pay a scheduling cost per partition on every pass (one
    per tree level per tree), so training data lies in partitions of about 128 MB
    of feature vectors.  A table below that is spread over the cluster's cores
    (``width``), but not into partitions of fewer than ``FEWEST_ROWS`` rows."""
    size = n_rows * (8 * n_features + 64)
    return max(1, -(-size // TRAINING_PARTITION_BYTES), min(width, n_rows // FEWEST_ROWS))


def train_candidates(td: TrainingData, names: list[str] | None = None,
                     parallelism: int = 1) -> list[RunResult]:
    """Each candidate trained once on the persisted training rows;
    failures are isolated; at least one must succeed; wall time recorded.

    ``parallelism > 1`` fits candidates concurrently from a thread pool (as
    Spark ML's ``CrossValidator(parallelism=...)`` does).  Measured locally it
    does not pay: the boosted trees slow down by more than the other
    candidates save, so candidates are fitted one after the other by default."""
    spark = td.train.sparkSession
    st = td.train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("sd")).first()
    parts = training_partitions(st["n"], len(td.features), spark.sparkContext.defaultParallelism)
    train = td.train.repartition(parts).persist(StorageLevel.MEMORY_AND_DISK)
    train_s = td.train_scaled.repartition(parts).persist(StorageLevel.MEMORY_AND_DISK)
    train.count(), train_s.count()
    cands = [(n, e) for n, e in candidates(td.task, len(td.features), st["n"], st["sd"] or 0.0)
             if not names or n in names]

    def fit_one(item):
        name, est = item
        scaled = name in SCALED_MODELS
        t0 = time.time()
        try:
            model = _pipeline(td.features, est).fit(train_s if scaled else train)
            pred = score(model, td.test_scaled if scaled else td.test, td.task)
            met = metrics_of(pred, td.task)
        except Exception as e:  # noqa: BLE001 -- one failing candidate must not stop the run
            print(f"candidate {name} failed: {e}", file=sys.stderr)
            return None
        return RunResult(name, model, scaled, pred, met, time.time() - t0)

    workers = max(1, min(parallelism, len(cands)))
    if workers == 1:
        out = [fit_one(c) for c in cands]
    else:
        from concurrent.futures import ThreadPoolExecutor
        with ThreadPoolExecutor(max_workers=workers) as pool:
            out = list(pool.map(fit_one, cands))
    train.unpersist()
    train_s.unpersist()
    results = [r for r in out if r is not None]
    if not results:
        raise RuntimeError("no candidate model could be trained")
    return results


def key_metric(task: str) -> str:
    return "F1" if task == "classification" else "R2"


def results_frame(spark: SparkSession, results: list[RunResult], task: str) -> DataFrame:
    """Small comparison input (one row per candidate) for L7."""
    keys = ["Accuracy", "F1", "Precision", "Recall", "ROC-AUC"] if task == "classification" else ["R2", "RMSE", "MAE"]
    rows = [(i, r.name, float(r.seconds), *[None if r.metrics.get(k) is None else float(r.metrics[k]) for k in keys])
            for i, r in enumerate(results)]
    schema = "ordre int, modele string, temps_secondes double, " + ", ".join(
        f"`{k.replace('-', '_')}` double" for k in keys)
    return spark.createDataFrame(rows, schema)


def select_best(results: list[RunResult], task: str) -> RunResult:
    """Max key metric, the first candidate wins ties (``evaluate.best_result``)."""
    spark = results[0].predictions.sparkSession
    best = evaluate.best_result(results_frame(spark, results, task), key_metric(task)).first()
    return results[best["ordre"] if best["ordre"] is not None else 0]


def feature_importance(spark: SparkSession, result: RunResult, features: list[str], k: int | None = 20) -> DataFrame:
    """Tree importances, else |coefficients|, else none; descending; the
    first ``k`` (all if None)."""
    m = result.model.stages[-1]
    if hasattr(m, "featureImportances"):
        vals = m.featureImportances.toArray().tolist()
    elif hasattr(m, "coefficients"):
        vals = [abs(v) for v in m.coefficients.toArray().tolist()]
    else:
        return spark.createDataFrame([], "variable string, importance double")
    df = spark.createDataFrame(list(zip(features, [float(v) for v in vals])), "variable string, importance double")
    df = df.orderBy(F.col("importance").desc(), F.col("variable"))
    return df if k is None else df.limit(k)


def model_checks(result: RunResult, td: TrainingData) -> DataFrame:
    """One row on a trained candidate, computed from its scores: test rows,
    whether it predicts more than one value, whether it beats the training
    mean (the majority class), and whether tree importances sum to one."""
    if td.task == "classification":
        base = td.train.groupBy("label").count().orderBy(F.desc("count"), "label").limit(1).select(F.col("label").alias("_base"))
        def hits(c):
            return F.sum((F.col("label") == F.col(c)).cast("long"))
        better = hits("prediction") >= hits("_base")
    else:
        base = td.train.agg(F.avg("label").alias("_base"))
        def miss(c):
            return F.sum((F.col("label") - F.col(c)) * (F.col("label") - F.col(c)))
        better = miss("prediction") < miss("_base")
    m = result.model.stages[-1]
    total = float(sum(m.featureImportances.toArray())) if hasattr(m, "featureImportances") else None
    return result.predictions.crossJoin(F.broadcast(base)).agg(
        F.count(F.lit(1)).alias("n_test"), (F.min("prediction") < F.max("prediction")).alias("varies"), better.alias("better")) \
        .select(F.lit(result.name).alias("modele"), "n_test", "varies", "better",
                F.lit(None if total is None else round(total, 6)).cast("double").alias("importance_sum"))


def gradient_residuals(result: RunResult, td: TrainingData) -> DataFrame:
    """K5, K6: the equation that the optimum of a penalised linear or logistic
    model meets for each feature, sum x (y' - y) + w = 0 with y' the prediction
    or the positive probability, as a share of sum |x y|."""
    weights = result.model.stages[-1].coefficients.toArray().tolist()
    scored = result.model.transform(td.train_scaled)
    guess = vector_to_array("probability")[1] if td.task == "classification" else F.col("prediction")
    gap = guess - F.col("label")
    sums = scored.agg(*[e for f in td.features for e in (
        F.sum(F.col(f) * gap).alias(f"{f}__g"), F.sum(F.abs(F.col(f) * F.col("label"))).alias(f"{f}__s"))])
    rows = ", ".join(f"'{f}', (`{f}__g` + {w!r}D) / greatest(`{f}__s`, 1D)" for f, w in zip(td.features, weights, strict=True))
    return sums.selectExpr(f"stack({len(weights)}, {rows}) as (feature, residual)")


# --- M3: artefact --------------------------------------------------------------

def save_artefact(path: str, result: RunResult, td: TrainingData, threshold: float | None,
                  test_years: int = C.TEST_YEARS) -> str:
    """M3: Spark ML model + preprocessing state (medians, dictionary, scaler)
    as small tables + a JSON descriptor, written under ``path`` (a shared
    folder on a cluster)."""
    result.model.write().overwrite().save(os.path.join(path, "model"))
    td.medians.write.mode("overwrite").parquet(os.path.join(path, "medians"))
    td.dictionary.write.mode("overwrite").parquet(os.path.join(path, "dictionary"))
    td.scaler.write.mode("overwrite").parquet(os.path.join(path, "scaler"))
    meta = {"model_name": result.name, "task_type": td.task, "target": td.target,
            "feature_cols": td.features, "num_cols": td.num_cols, "cat_cols": td.cat_cols,
            "scaler_required": result.scaled, "threshold_alert": threshold, "test_years": test_years}
    save_descriptor(td.train.sparkSession, path, meta)
    return path


DESCRIPTOR = ("model_name string, task_type string, target string, feature_cols array<string>, num_cols array<string>, "
              "cat_cols array<string>, scaler_required boolean, threshold_alert double, test_years int")


def save_descriptor(spark: SparkSession, path: str, meta: dict) -> None:
    spark.createDataFrame([(json.dumps(meta, ensure_ascii=False),)], "meta string") \
        .coalesce(1).write.mode("overwrite").text(os.path.join(path, "meta"))


def read_descriptor(spark: SparkSession, path: str) -> DataFrame:
    """M3: the stored descriptor as a one-row parameter table."""
    return one_row(spark.read.schema(DESCRIPTOR).json(os.path.join(path, "meta")))


@dataclass
class Artefact:
    meta: dict
    model: PipelineModel
    medians: DataFrame
    dictionary: DataFrame
    scaler: DataFrame


def load_artefact(spark: SparkSession, path: str) -> Artefact:
    meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()[0])
    return Artefact(meta, PipelineModel.load(os.path.join(path, "model")),
                    spark.read.parquet(os.path.join(path, "medians")),
                    spark.read.parquet(os.path.join(path, "dictionary")),
                    spark.read.parquet(os.path.join(path, "scaler")))


def apply_descriptor(obs: DataFrame, descriptor: DataFrame, target: str, task: str) -> DataFrame:
    """M3 override: the stored alert threshold, joined in as a one-row table,
    replaces the fitted one; the flag and the level of its target follow.  A
    descriptor without a threshold leaves the flag as it is."""
    out = obs
    if "proxy_pm25" in obs.columns:
        stored = descriptor.select(F.col("threshold_alert").alias("_stored"))
        flag = alert_flag(F.col("proxy_pm25"), F.col("_stored"))
        if "alerte_pollution" in obs.columns:
            flag = F.when(F.col("_stored").isNull(), F.col("alerte_pollution")).otherwise(flag)
        out = obs.crossJoin(F.broadcast(stored)).withColumn("alerte_pollution", flag).drop("_stored")
    if target in out.columns:
        out = out.withColumn("niveau_alerte", level_expr(F.col(target), C.target_config(target, task)))
    return out


def apply_artefact(obs: DataFrame, art: Artefact) -> DataFrame:
    """``apply_descriptor`` with a loaded artefact's own descriptor."""
    one = obs.sparkSession.createDataFrame([(art.meta.get("threshold_alert"),)], "threshold_alert double")
    return apply_descriptor(obs, one_row(one), art.meta["target"], art.meta["task_type"])


# --- J5: model forecast ------------------------------------------------------------

def forecast_model(future: DataFrame, art: Artefact, city: str = "ville") -> DataFrame:
    """Encode the future rows (K4), scale if the model needs it, predict,
    clip index targets to [0, 100], level bands for the proxy, class labels
    and positive probability for classification, source text."""
    meta = art.meta
    feats, nums, cats = meta["feature_cols"], meta["num_cols"], meta["cat_cols"]
    enc = prep.encode_for_model(future.select(city, "date", *[c for c in feats if c in future.columns]),
                                feats, nums, cats, art.medians, art.dictionary)
    if meta.get("scaler_required"):
        enc = prep.scale(enc, art.scaler, feats)
    task = meta["task_type"]
    out = score(art.model, enc, task)
    target = meta["target"]
    if task == "classification":
        out = out.withColumn("niveau", level_expr(F.col("prediction"), C.target_config(target, task)))
    else:
        if target in ("proxy_pm25", "score_risque", "indice_stagnation"):
            out = out.withColumn("prediction", clip(F.col("prediction"), 0, 100))
        lvl = level_expr(F.col("prediction"), C.target_config(target)) if target == "proxy_pm25" \
            else F.lit(None).cast(T.StringType())
        out = out.withColumn("niveau", lvl)
    cols = [city, "date", "prediction", "niveau"] + (["score_prediction"] if task == "classification" else [])
    return out.select(*cols, F.lit(f"Artefact pipeline - {meta.get('model_name', 'modèle exporté')}")
                      .alias("source_prevision"))


def linear_sql(result: RunResult, td: TrainingData) -> str:
    """A linear candidate as one SQL expression over raw feature columns
    (imputed, coded, scaled and weighted in place), which any SQL engine runs."""
    medians, scale = td.medians.first(), td.scaler.first()
    codes: dict[str, list] = {}
    for r in td.dictionary.collect():                        # one entry per distinct category value
        codes.setdefault(r["column"], []).append((r["value"], r["code"]))
    m = result.model.stages[-1]
    terms = [f"{m.intercept!r}"]
    for name, w in zip(td.features, m.coefficients.toArray().tolist(), strict=True):
        if name in td.cat_cols:
            whens = " ".join("WHEN '" + v.replace("'", "''") + f"' THEN {c}" for v, c in codes.get(name, []))
            x = f"(CASE {name} {whens} ELSE -1 END)" if whens else "-1"
        else:
            median = medians[name]
            x = f"coalesce({name}, {0.0 if median is None else median!r})"
        terms.append(f"{w!r} * (({x} - {scale[name + '__mean']!r}) / {scale[name + '__scale']!r})")
    return " + ".join(f"cast({t} as double)" for t in terms)


def forecast_linear(future: DataFrame, result: RunResult, td: TrainingData, city: str = "ville") -> DataFrame:
    """J5 for a linear candidate without its artefact's pipeline: ``linear_sql``
    on the future rows, clipped and banded like ``forecast_model``."""
    out = future.withColumn("prediction", F.expr(linear_sql(result, td).replace("`", "")))
    if td.target in ("proxy_pm25", "score_risque", "indice_stagnation"):
        out = out.withColumn("prediction", clip(F.col("prediction"), 0, 100))
    level = level_expr(F.col("prediction"), C.target_config(td.target)) if td.target == "proxy_pm25" else F.lit(None).cast("string")
    return out.select(city, "date", "prediction", level.alias("niveau"))
