"""Row-based windows that stay exact when one group holds a large share of
the rows.

``halo_window_columns``: lag / trailing-row expressions normally computed
over ``Window.partitionBy(group).orderBy(...)``.  Rows are instead
partitioned by (group, bucket), where a bucket is a range of (day, row key) that
holds about rows / shuffle-partitions rows, and every (group, bucket) partition
receives a *halo*: the ``halo`` rows that precede it in the group's order.
Halo rows are taken from a tail table holding the last ``halo`` rows of every
(group, bucket); each tail row is sent to at most ``halo`` following buckets.
A group is so split into as many tasks as its share of the rows asks for,
also when all its rows lie on one day or have no date, and lags of up to ``halo`` rows and
trailing windows of up to ``halo`` rows are identical to the unsplit window.
Groups below that share are windowed whole, without a halo.

``last_k``: the last k rows per group in two phases (k per (group, bucket),
then k among those candidates), so no single window sorts a whole group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envspark.functions.joins import join_keys
from envspark.session import materialize

NULL_BUCKET = 1 << 30
FIRST_KEY, LAST_KEY = -(1 << 63), (1 << 63) - 1


def year_bucket(date_col: str = "date") -> Column:
    return F.coalesce(F.year(F.col(date_col)), F.lit(NULL_BUCKET))


def order_keys(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


def _place(df: DataFrame, order: Sequence[str]) -> tuple[Column, Column]:
    """(day, key) of a row as non-null numbers that sort like ``order`` with
    nulls last; the key is 0 where the order has no numeric second column."""
    day = F.coalesce(F.unix_date(F.to_date(order[0])), F.lit(NULL_BUCKET))
    if len(order) > 1 and isinstance(df.schema[order[1]].dataType, T.IntegralType):
        return day, F.coalesce(F.col(order[1]).cast("long"), F.lit(LAST_KEY))
    return day, F.lit(0).cast("long")


def range_starts(df: DataFrame, group: str, order: Sequence[str], parts: int) -> DataFrame:
    """The groups that are split, with the (day, key) at which each of their
    buckets starts (``_starts``, ascending; rows before the first are bucket 0).

    Rows are counted per (group, day) with map-side combining; a bucket ends
    once it holds a ``parts``-th of all rows.  A day (or the rows without a
    date) that alone holds more is cut again at quantiles of the key.  There
    are at most 2 x ``parts`` starts over all groups."""
    day, key = _place(df, order)
    placed = df.select(F.col(group).alias("_g"), day.alias("_d"), key.alias("_i"))
    days = placed.groupBy("_g", "_d").agg(F.count(F.lit(1)).alias("_n"))
    per = days.agg(F.greatest(F.ceil(F.sum("_n") / F.lit(parts)), F.lit(1)).alias("_per"))
    w = Window.partitionBy("_g").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)    # one row per day
    sized = days.crossJoin(F.broadcast(per))
    cut = sized.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))) \
        .groupBy("_g", F.floor(F.col("_before") / F.col("_per")).alias("_k")).agg(F.min("_d").alias("_d")) \
        .where("_k > 0").select("_g", "_d", F.lit(FIRST_KEY).cast("long").alias("_i"))
    # fewer than `parts` such days: each holds more than a `parts`-th of the rows
    hot = sized.where(F.col("_n") > F.col("_per")).select("_g", "_d", F.ceil(F.col("_n") / F.col("_per")).cast("int").alias("_m"))
    probs = [i / parts for i in range(1, parts)]
    inner = join_keys(placed, F.broadcast(hot), ["_g", "_d"]).groupBy("_g", "_d", "_m").agg(F.percentile_approx("_i", probs, 10_000).alias("_p")) \
        .where("_m > 1").select("_g", "_d", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.col("_m"), F.lit(parts)) - 1), lambda j: F.element_at(
            "_p", F.floor(j * F.lit(parts) / F.col("_m")).cast("int")))).alias("_i"))
    every = cut if parts < 2 else cut.unionByName(inner)
    return every.groupBy(F.col("_g").alias(group)).agg(F.sort_array(F.collect_set(F.struct("_d", "_i"))).alias("_starts"))


def halo_window_columns(df: DataFrame, group: str, order: Sequence[str], needed: Sequence[str],
                        halo: int, build: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """Adds the columns returned by ``build(window)`` where ``window`` is the
    (group, bucket) window ordered by ``order`` (a date first); results equal
    the same expressions over the plain per-group window as long as they look
    back at most ``halo`` rows.  Rows whose group is NULL form their own group;
    rows without a date are a group's last.  The starts are written once and
    read first: where no group is split, the plain window is the whole plan."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = materialize(range_starts(df, group, order, parts), "range-starts")
    if starts.isEmpty():
        return df.withColumns(build(Window.partitionBy(group).orderBy(*order_keys(order))))
    day, key = _place(df, order)
    bucket = F.when(F.col("_starts").isNull(), F.lit(0)).otherwise(
        F.size(F.filter("_starts", lambda x: x <= F.struct(day.alias("_d"), key.alias("_i")))))
    # bounded: at most 2 x shuffle partitions starts in all
    base = _join_null_safe(df, F.broadcast(starts), group).withColumn("_bk", bucket).withColumn("_split", F.col("_starts").isNotNull()) \
        .drop("_starts").withColumn("_halo", F.lit(False))
    cols = list(dict.fromkeys([group, *order, *needed]))
    # last `halo` rows of every (group, bucket)
    wt = Window.partitionBy(group, "_bk").orderBy(*[F.col(c).desc_nulls_first() for c in order])
    split = base.where("_split")
    tails = (split.select(*cols, "_bk").withColumn("_r", F.row_number().over(wt))
                 .where(F.col("_r") <= halo).drop("_r"))
    # per group: every bucket and the number of tail rows before it
    per_bucket = split.groupBy(group, "_bk").agg(F.count(F.lit(1)).alias("_n"))
    wb = Window.partitionBy(group).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    buckets = per_bucket.withColumn("_e", F.coalesce(F.sum(F.least(F.col("_n"), F.lit(halo))).over(wb),
                                                     F.lit(0)))
    blist = buckets.groupBy(group).agg(F.collect_list(F.struct(F.col("_bk").alias("b"), F.col("_e").alias("e")))
                                        .alias("_bl"))     # one entry per bucket of the group: bounded
    wp = Window.partitionBy(group).orderBy("_bk", *order_keys(order))
    tails = tails.withColumn("_p", F.row_number().over(wp))   # <= halo x buckets rows per group
    t = _join_null_safe(tails, blist, group)
    targets = F.filter(F.col("_bl"), lambda x: (x["b"] > F.col("_bk")) & (F.col("_p") <= x["e"])
                       & (F.col("_p") > x["e"] - F.lit(halo)))
    halo_rows = (t.select(*cols, F.explode(targets).alias("_to"))
                  .select(*cols, F.col("_to.b").alias("_bk"), F.lit(True).alias("_halo")))
    u = base.select(*df.columns, "_bk", "_halo").unionByName(
        halo_rows.select(*[F.col(c) if c in cols else F.lit(None).cast(df.schema[c].dataType).alias(c)
                           for c in df.columns], "_bk", "_halo"))
    w = Window.partitionBy(group, "_bk").orderBy(*order_keys(order))
    exprs = build(w)
    return u.withColumns(exprs).where(~F.col("_halo")).drop("_bk", "_halo")


def _join_null_safe(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    r = right.withColumnRenamed(key, "__k")
    return left.join(r, left[key].eqNullSafe(r["__k"]), "left").drop("__k")


def last_k(df: DataFrame, group: Sequence[str], order_desc: Sequence[Column], k: int,
           bucket: Column, rank_col: str = "_rn") -> DataFrame:
    """The last k rows of every group (rank 1 = last) in two phases: k per
    (group, bucket), then k among those <= k x buckets candidates."""
    g = list(group)
    pre = df.withColumn("_b", bucket)
    w1 = Window.partitionBy(*g, "_b").orderBy(*order_desc)
    cand = pre.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1", "_b")
    w2 = Window.partitionBy(*g).orderBy(*order_desc)
    return cand.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)
