"""Connected components of a link table, as Spark joins.

Alternating large-star and small-star rounds: every vertex points its larger
(smaller) neighbours at the least vertex it knows until nothing changes.  Each
round is a grouped minimum (combined before the shuffle) and a join that
adaptive execution splits when one vertex has many links; the edge table is
written to the shared folder, so lineage stays short and lost executors are no
loss.  Nothing is gathered on the driver but two counters per round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.llm import common as C


def _both(e: DataFrame) -> DataFrame:
    return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(e: DataFrame) -> DataFrame:
    n = _both(e)
    least = n.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return n.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    # a < b holds: b's smaller neighbours are the a's
    least = e.groupBy("b").agg(F.min("a").alias("m"))
    j = e.join(least, "b")
    moved = j.select(F.col("m").alias("x"), F.col("a").alias("y")).union(j.select(F.col("m").alias("x"), F.col("b").alias("y")))
    return moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) -> (id, component_id): every vertex of an edge
    with the least vertex it reaches.  Self links and repeats are allowed."""
    spark = edges.sparkSession
    e = C.materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                      .distinct(), "links")
    last = None
    while True:
        e = C.materialize(_small_star(_large_star(e)), "links")
        # xor of pair hashes and the count: unchanged tables keep both
        now = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(now) == last or not now[0]:
            break
        last = tuple(now)
    C.release(spark)
    return e.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component_id")) \
        .union(e.select(F.col("a").alias("id"), F.col("a").alias("component_id")).distinct())


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, least vertex of its local component) for links held in one
    task: minimum labels with pointer jumping."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inv[:len(a)], inv[len(a):]
    label = np.arange(len(ids))
    while True:
        m = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], m)
        np.minimum.at(new, label[v], m)
        new = np.minimum(new, new[label])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = label != np.arange(len(ids))
    return ids[own], ids[label[own]]
