"""Language identification by hierarchical discrimination (operator 2).

A text is first given to a language family, then one-versus-one linear support
vector machines separate the languages of that family.  Features are the
relative frequencies of hashed byte trigrams of the lower-cased text (runs of
ASCII non-letters count as one space), over the whole text.

Training: languages and their counts come from all labelled rows; the
classifiers are fitted on a bounded sample, about ``sample_per_language``
documents of each language, taken by a hash of id and text.  Families are
found by average-linkage clustering of the languages' mean profiles, down to
the square root of their number.  Every binary problem (family against the
rest, language against language within a family) is its own Spark group and
trained there by dual coordinate descent.  What returns to the driver and is
broadcast is one weight vector per problem: it grows with the number of
languages, not with the documents.

Defined results: ``und`` with score 0 if the text is null, has no letter, or
nothing was learned; with one learned language all other texts get it; null
or repeated ids change nothing but the sample; extra columns are ignored;
empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envspark.llm import common as C

BITS = 15
DIM = 1 << BITS
TEXT_STEP = 1 << 20
_LETTER = regex.compile(r"\p{L}").search
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    family: list[int]              # family of each language
    families: np.ndarray           # DIM x number of families (one-versus-rest)
    family_bias: np.ndarray
    pairs: list[tuple[int, int]]   # languages of each pair problem
    pair_weights: np.ndarray       # DIM x number of pairs; positive: the first language
    pair_bias: np.ndarray


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of a whole text."""
    b = _FOLD[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    space = b == 32
    keep = np.ones(len(b), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    b = b[keep].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    code = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
    return (code >> np.uint32(32 - BITS)).astype(np.int64)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, idx, val: the sparse trigram frequencies of each sample text."""
    for b in batches:
        langs, idx, val = [], [], []
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            h = trigrams(text or "")
            if len(h):
                i, n = np.unique(h, return_counts=True)
                langs.append(lang)
                idx.append(i.astype(np.int32).tobytes())
                val.append((n / len(h)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(idx, pa.binary()), pa.array(val, pa.binary())],
                                         names=["lang", "idx", "val"])


def _centroid(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(DIM)
    for i, v in zip(pdf["idx"], pdf["val"], strict=True):
        total[np.frombuffer(i, np.int32)] += np.frombuffer(v, np.float32)
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "mean": [(total / len(pdf)).astype(np.float32).tobytes()]})


def cluster(means: np.ndarray) -> list[int]:
    """Average-linkage families of the rows' cosine similarities."""
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-30)
    sim = unit @ unit.T
    groups = [[i] for i in range(len(means))]
    while len(groups) > max(1, round(len(means) ** 0.5)):
        best = max(((sim[np.ix_(a, b)].mean(), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        i, j = -best[1], -best[2]
        groups[i] += groups.pop(j)
    out = [0] * len(means)
    for g, members in enumerate(groups):
        for m in members:
            out[m] = g
    return out


def train_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float, epochs: int) -> tuple[np.ndarray, float]:
    """L2-loss linear support vector machine by dual coordinate descent; the
    bias is a constant feature; both classes weigh the same in total."""
    w, bias = np.zeros(DIM), 0.0
    alpha = np.zeros(len(rows))
    share = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
    diag = 1.0 / (2 * cost * share)
    square = np.array([float(v @ v) + 1.0 for _, v in rows]) + diag
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            idx, v = rows[i]
            grad = y[i] * (w[idx] @ v + bias) - 1 + diag[i] * alpha[i]
            new = max(alpha[i] - grad / square[i], 0.0)
            if new != alpha[i]:
                w[idx] += (new - alpha[i]) * y[i] * v
                bias += (new - alpha[i]) * y[i]
                alpha[i] = new
    return w, bias


def _trainer(scale: float, cost: float, epochs: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        # the group's rows come in any order: sorted, so that every run fits the same model
        pdf = pdf.sort_values(["lang", "idx", "val"])
        rows = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32).astype(float) * scale)
                for i, v in zip(pdf["idx"], pdf["val"], strict=True)]
        w, bias = train_svm(rows, pdf["y"].to_numpy(float), cost, epochs)
        return pd.DataFrame({"problem": [int(pdf["problem"].iloc[0])], "weights": [(w * scale).astype(np.float32).tobytes()],
                             "bias": [bias]})
    return fit


def fit(labelled: DataFrame, sample_per_language: int = 400, cost: float = 10.0, epochs: int = 12) -> Model | None:
    """Learn from ``labelled`` (doc_id, text, lang); rows without text or lang
    are left out.  None if nothing can be learned."""
    spark = labelled.sparkSession
    C.small_batches(spark)
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", C.row_key("doc_id", "text").alias("_h"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    pick = (F.pmod("_h", F.lit(1 << 40)) / float(1 << 40)) * F.col("_n") < sample_per_language
    # one row per language, like the model itself: the texts are not shuffled on a language; repeated rows count once
    sample = C.materialize(rows.join(F.broadcast(counts), "lang").where(pick).dropDuplicates(["lang", "_h"]).select("lang", "text").mapInArrow(
        C.tidy(_profiles), "lang string, idx binary, val binary"), "language-sample")
    means = sorted(sample.groupBy("lang").applyInPandas(_centroid, "lang string, mean binary").collect())
    if not means:
        return None
    languages = [r["lang"] for r in means]
    mean = np.array([np.frombuffer(r["mean"], np.float32) for r in means], float)
    family = cluster(mean)
    scale = 1.0 / float(np.mean(np.linalg.norm(mean, axis=1)))
    n_fam = max(family) + 1
    pairs = [(a, b) for a in range(len(languages)) for b in range(a + 1, len(languages)) if family[a] == family[b]]
    plan = [(lang, f, 1 if family[i] == f else -1) for f in range(n_fam if n_fam > 1 else 0) for i, lang in enumerate(languages)]
    plan += [(languages[i], n_fam + p, y) for p, ab in enumerate(pairs) for i, y in zip(ab, (1, -1), strict=True)]
    fam_w, fam_b = np.zeros((DIM, n_fam), np.float32), np.zeros(n_fam)
    pair_w, pair_b = np.zeros((DIM, len(pairs)), np.float32), np.zeros(len(pairs))
    if plan:
        roles = spark.createDataFrame(plan, "lang string, problem int, y int")
        fitted = sample.join(roles, "lang").groupBy("problem").applyInPandas(
            _trainer(scale, cost, epochs), "problem int, weights binary, bias double").collect()
        for r in fitted:
            w = np.frombuffer(r["weights"], np.float32)
            if r["problem"] < n_fam:
                fam_w[:, r["problem"]], fam_b[r["problem"]] = w, r["bias"]
            else:
                pair_w[:, r["problem"] - n_fam], pair_b[r["problem"] - n_fam] = w, r["bias"]
    return Model(languages, family, fam_w, fam_b, pairs, pair_w, pair_b)


def _mean_weights(h: np.ndarray, weights: np.ndarray) -> np.ndarray:
    total = np.zeros(weights.shape[1])
    for i in range(0, len(h), TEXT_STEP):
        part = np.bincount(h[i:i + TEXT_STEP], minlength=DIM) if len(h) > DIM else None
        total += part @ weights if part is not None else weights[h[i:i + TEXT_STEP]].sum(0, dtype=float)
    return total / len(h)


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def predict_text(text: str | None, m: Model | None) -> tuple[str, float]:
    if m is None or not text or not _LETTER(text):
        return UNKNOWN, 0.0
    h = trigrams(text)
    if not len(h):
        return UNKNOWN, 0.0
    margins = _mean_weights(h, m.families) + m.family_bias
    fam = int(np.argmax(margins))
    score = _logistic(2 * margins[fam]) if len(margins) > 1 else 1.0
    members = [i for i, f in enumerate(m.family) if f == fam]
    if len(members) == 1:
        return m.languages[members[0]], score
    cols = [k for k, (a, _) in enumerate(m.pairs) if m.family[a] == fam]
    value = _mean_weights(h, m.pair_weights[:, cols]) + m.pair_bias[cols]
    wins = dict.fromkeys(members, 0)
    least = dict.fromkeys(members, np.inf)
    for v, k in zip(value, cols, strict=True):
        a, b = m.pairs[k]
        wins[a if v >= 0 else b] += 1
        least[a], least[b] = min(least[a], v), min(least[b], -v)
    best = max(members, key=lambda i: (wins[i], least[i], -i))
    return m.languages[best], score * _logistic(2 * least[best])


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, lang_pred and score, one row per input row."""
    spark = docs.sparkSession
    C.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    src = docs.select(*keep, "text")
    schema = src.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [predict_text(x, shared.value) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(keep)], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=[*keep, "lang_pred", "score"])

    return src.mapInArrow(C.tidy(run), schema)


@F.pandas_udf(T.BooleanType())
def has_letter(text: pd.Series) -> pd.Series:
    """What a language can be told of at all, whatever was learned."""
    return text.map(lambda x: bool(x and _LETTER(x))).astype(bool)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id's text mod 3 is 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
