"""Distributed prefix sums and exact quantiles.

``cumulative_counts``: running totals of count columns over a sorted key
within groups, without a single-partition window.  The sort key is cut into
value ranges by approximate quantiles (per group, as many as the group's share
of the rows asks for); range totals get their offsets on the small (group,
range) table; the in-range running sum is a window partitioned by (group,
range).

``exact_quantiles``: exact linear-interpolated quantiles (the same
definition and arithmetic as Spark's ``percentile``) for one or many
groups.  Approximate quantiles bracket each position; brackets that still hold
more distinct values than one task should put in order are narrowed by further
passes; only the values inside are put in order.  No aggregation buffer holds
a group and no task holds more than ``BRACKET_VALUES`` distinct values.

Per-group parameters meet the rows by a broadcast whose size is checked
(``BROADCAST_GROUPS`` rows; beyond it a shuffle join), so rows are not shuffled
on a region or a column name.  A row of maps would do the same for few groups,
but a map is searched from its start for every row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from envspark.functions.joins import join_keys
from envspark.session import one_row

# Groups whose parameters may be broadcast (a few hundred bytes each).
BROADCAST_GROUPS = 50_000


def _range_cuts(c: DataFrame, keys: list[str], ranges: int) -> DataFrame:
    """Per group that holds at least two ``ranges``-ths of the rows: its key
    values at which a new range starts, in proportion to its rows.  At most
    ``ranges`` groups with at most 2 x ``ranges`` cuts over all of them."""
    sizes = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    per = sizes.agg(F.greatest(F.ceil(F.sum("_n") / F.lit(ranges)), F.lit(1)).alias("_per"))
    big = sizes.crossJoin(F.broadcast(per)).where(F.col("_n") >= 2 * F.col("_per")) \
        .select(*keys, F.least(F.ceil(F.col("_n") / F.col("_per")), F.lit(ranges)).cast("int").alias("_k"))
    probs = [i / ranges for i in range(1, ranges)]
    fine = join_keys(c, F.broadcast(big), keys).groupBy(*keys, "_k").agg(F.percentile_approx("_o", probs, 1000).alias("_p"))
    picked = F.transform(F.sequence(F.lit(1), F.col("_k") - 1), lambda j: F.element_at("_p", F.floor(j * F.lit(ranges) / F.col("_k")).cast("int")))
    return fine.select(*keys, picked.alias("_cuts"))


def cumulative_counts(counts: DataFrame, order: str, cols: Sequence[str], by: Sequence[str] = (),
                      descending: bool = False) -> DataFrame:
    """Adds ``_c<col>`` = sum of ``col`` over rows strictly before this one in
    ``order`` (ascending, or descending) within each ``by`` group.  ``order``
    values must be distinct within a group (count them first).  Over all
    groups there are about as many ranges as the shuffle has partitions; a
    small group is one range."""
    keys = list(by)
    ranges = max(2, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sgn = F.lit(-1.0) if descending else F.lit(1.0)
    c = counts.withColumn("_o", F.col(order).cast("double") * sgn)
    probs = [i / ranges for i in range(1, ranges)]
    if keys:
        # bounded: see _range_cuts
        c = join_keys(c, F.broadcast(_range_cuts(c, keys, ranges)), keys, "left")
    else:
        c = c.crossJoin(F.broadcast(c.agg(F.percentile_approx("_o", probs, 1000).alias("_cuts"))))
    c = c.withColumn("_b", F.greatest(F.size(F.filter(F.col("_cuts"), lambda x: x < F.col("_o"))), F.lit(0))).drop("_cuts")
    tot = c.groupBy(*keys, "_b").agg(*[F.sum(x).alias(f"_t{x}") for x in cols])
    wb = (Window.partitionBy(*keys) if keys else Window).orderBy("_b") \
        .rowsBetween(Window.unboundedPreceding, -1)
    # one row per (group, range)
    off = tot.select(*keys, "_b", *[F.coalesce(F.sum(f"_t{x}").over(wb), F.lit(0)).alias(f"_off{x}")
                                    for x in cols])
    c = join_keys(c, off, [*keys, "_b"])
    wi = Window.partitionBy(*keys, "_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    return c.withColumns({f"_c{x}": F.col(f"_off{x}") + F.coalesce(F.sum(x).over(wi), F.lit(0))
                          for x in cols}).drop("_o", "_b", *[f"_off{x}" for x in cols])


# Rank error of the approximate quantiles that bracket an exact one, as a
# share of the rows.
ACCURACY = 10_000
# Distinct values of one bracket that one task may put in order (24 bytes each).
BRACKET_VALUES = 1 << 20
# A further pass narrows a bracket to about 5 / GRID of its rows.
GRID = 1_000
GRID_ACCURACY = 10_000


class _Slots:
    """Quantile positions of columns: slot s is column ``col[s]`` at ``prob[s]``.
    Expressions are SQL text: there are many of them, and each is one call."""

    def __init__(self, n_cols: int, probs: Sequence[float]) -> None:
        self.col = [i for i in range(n_cols) for _ in probs]
        self.prob = [float(p) for _ in range(n_cols) for p in probs]
        self.all = range(len(self.col))
        self.each = f"sequence(0, {len(self.col) - 1})"

    def below(self, s: int) -> str:
        return f"_v{self.col[s]} < _e[{2 * s}]"

    def above(self, s: int) -> str:
        return f"_v{self.col[s]} > _e[{2 * s + 1}]"

    def positions(self) -> str:
        cols, probs = ", ".join(map(str, self.col)), ", ".join(f"{p!r}D" for p in self.prob)
        return f"transform({self.each}, s -> cast(_n[array({cols})[s]] - 1 as double) * array({probs})[s])"

    def inside(self, j: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, slot, value) of the values inside their brackets."""
        items = ", ".join(f"struct({s} as _s, _v{self.col[s]} as _v, (_v{self.col[s]} >= _e[{2 * s}] and not {self.above(s)}) as _ok)" for s in self.all)
        return j.select(*keys, F.expr(f"explode(filter(array({items}), x -> coalesce(x._ok, false)))").alias("_x")).select(*keys, "_x._s", "_x._v")

    def arrays(self, **per_slot) -> list:
        return [F.expr("array(" + ", ".join(f"{prefix}{s}" for s in self.all) + ")").alias(name) for name, prefix in per_slot.items()]


def _narrow(v: DataFrame, b: DataFrame, keys: list[str], slots: _Slots, meet, group) -> tuple[DataFrame, int]:
    """One pass: brackets with more than ``BRACKET_VALUES`` distinct values
    narrowed around their positions, and the largest number found."""
    b = b if keys else one_row(b)
    j = meet(v, b)
    below = group(j).agg(*[F.expr(f"count_if({slots.below(s)}) as _b{s}") for s in slots.all]).select(*keys, *slots.arrays(_below="_b"))
    grid = [i / GRID for i in range(GRID + 1)]
    held = slots.inside(j, keys).groupBy(*keys, "_s").agg(
        F.count(F.lit(1)).alias("_in"), F.approx_count_distinct("_v").alias("_kinds"), F.percentile_approx("_v", grid, GRID_ACCURACY).alias("_g"))
    held = held.persist(StorageLevel.MEMORY_AND_DISK)            # one row per group and slot
    most = held.agg(F.max("_kinds")).first()[0] or 0
    if most <= BRACKET_VALUES:
        return b, most
    packed = held.where(F.col("_kinds") > BRACKET_VALUES).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_s", F.struct("_in", "_g")))).alias("_m"))
    known = meet(meet(b, below), packed, "left") if keys else b.crossJoin(below).crossJoin(packed)
    # grid points around the position's share of the bracket; the old edge where there is none
    first, last = (f"((floor(_pos[s]) - _below[s]) / x._in)", "((ceil(_pos[s]) - _below[s] + 1) / x._in)")
    lo, hi = f"cast(floor({first} * {GRID}) - 2 as int)", f"cast(ceil({last} * {GRID}) + 2 as int)"
    edge = (f"transform(array(try_element_at(_m, s)), x -> array("
            f"if({lo} > 0 and {lo} <= {GRID}, x._g[{lo}], _e[2 * s]), if({hi} >= 0 and {hi} < {GRID}, x._g[{hi}], _e[2 * s + 1])))[0]")
    return known.select(*keys, "_n", "_pos", F.expr(f"flatten(transform({slots.each}, s -> {edge}))").alias("_e")).persist(StorageLevel.MEMORY_AND_DISK), most


def _quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], keys: list[str]) -> DataFrame:
    """One row per group: ``keys`` and ``_q``, the quantiles in slot order."""
    slots = _Slots(len(cols), probs)
    v = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])
    if len(cols) == 1:
        v = v.where("_v0 IS NOT NULL")

    def group(t: DataFrame):
        return t.groupBy(*keys)
    edges = [min(max(p + s * 2 / ACCURACY, 0.0), 1.0) for p in probs for s in (-1, 1)]
    points, none = ", ".join(f"{e!r}D" for e in edges), f"array_repeat(cast(null as double), {len(edges)})"
    n = range(len(cols))
    b = group(v).agg(*[F.expr(e) for i in n for e in (
        f"count(_v{i}) as _n{i}", f"percentile_approx(_v{i}, array({points}), {ACCURACY}) as _e{i}")])
    b = b.select(*keys, F.expr("array(" + ", ".join(f"_n{i}" for i in n) + ")").alias("_n"),
                 F.expr("flatten(array(" + ", ".join(f"coalesce(_e{i}, {none})" for i in n) + "))").alias("_e"))
    b = b.withColumn("_pos", F.expr(slots.positions())).persist(StorageLevel.MEMORY_AND_DISK)      # one row per group
    n_groups, largest = b.agg(F.count(F.lit(1)), F.max(F.array_max("_n"))).first()

    def meet(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        if not keys:
            return left.crossJoin(F.broadcast(right))
        return join_keys(left, F.broadcast(right) if n_groups <= BROADCAST_GROUPS else right, keys, how)
    if (largest or 0) * 6 / ACCURACY > BRACKET_VALUES:
        most = BRACKET_VALUES + 1
        while most > BRACKET_VALUES:
            b, most = _narrow(v, b, keys, slots, meet, group)
    j = meet(v, b if keys else one_row(b))
    # the values next to the bracket can hold the rank beside it
    stats = group(j).agg(F.first("_n").alias("_n"), F.first("_pos").alias("_pos"), *[F.expr(e) for s in slots.all for e in (
        f"count_if({slots.below(s)}) as _b{s}", f"max(if({slots.below(s)}, _v{slots.col[s]}, null)) as _u{s}",
        f"min(if({slots.above(s)}, _v{slots.col[s]}, null)) as _o{s}")])
    stats = stats.select(*keys, "_n", "_pos", *slots.arrays(_below="_b", _under="_u", _over="_o"))
    w = Window.partitionBy(*keys, "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    cells = slots.inside(j, keys).groupBy(*keys, "_s", "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = meet(cells.withColumn("_from", F.coalesce(F.sum("_c").over(w), F.lit(0))), stats)

    def held(rank: str) -> str:
        # the value with 0-based rank r has _from <= r - below < _from + _c
        r = f"({rank}(_pos[_s]) - _below[_s])"
        return f"max(if(_from <= {r} and {r} < _from + _c, _v, null))"
    picks = placed.groupBy(*keys, "_s").agg(F.expr(held("floor") + " as lo"), F.expr(held("ceil") + " as hi"))
    picks = group(picks).agg(F.map_from_entries(F.collect_list(F.struct("_s", F.struct("lo", "hi")))).alias("_m"))

    def value(rank: str, side: str) -> str:
        return f"if({rank}(_pos[s]) < _below[s], _under[s], coalesce(try_element_at(_m, s).{side}, _over[s]))"
    found = f"transform({slots.each}, s -> struct(_pos[s] as p, {value('floor', 'lo')} as lo, {value('ceil', 'hi')} as hi))"
    result = ("transform(_f, y -> if(y.p < 0, null, if(ceil(y.p) = floor(y.p) or y.lo = y.hi, y.lo, "
              "(ceil(y.p) - y.p) * y.lo + (y.p - floor(y.p)) * y.hi)))")
    return meet(stats, picks, "left").withColumn("_f", F.expr(found)).select(*keys, F.expr(result).alias("_q"))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                    names: Sequence[str] | None = None) -> DataFrame:
    """One row per group with one column per probability (default names
    ``q0``, ``q1``...).  NULL values are ignored; a group without values is
    absent, and without groups the row is NULL.

    Two passes, and one more for every factor of about GRID / 5 by which a
    bracket is too wide.  Approximate quantiles (mergeable, with a guaranteed
    rank error) bracket each position; then the rows below a bracket are only
    counted, and the values inside, about 6 / ACCURACY of the rows, are counted
    by value and put in order.  The position is looked up in the exact counts,
    so the result is Spark's exact ``percentile``."""
    names = list(names or [f"q{i}" for i in range(len(probs))])
    q = _quantiles(df, [value], probs, list(by))
    return q.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def exact_medians_wide(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """One row with the exact median of each column.  All columns are
    bracketed in one aggregate and judged in another; only the few values
    inside a bracket become rows of their own."""
    if not cols:
        return df.sparkSession.range(1).select()
    q = _quantiles(df, list(cols), [0.5], [])
    return q.select(*[F.col("_q")[i].alias(f"{c}{suffix}") for i, c in enumerate(cols)])


def kth_value(df: DataFrame, value: str, k: int, n: int) -> float | None:
    """The ``k``-th smallest (from 1) of the ``n`` non-missing values of a numeric column."""
    if not 1 <= k <= n:
        return None
    return _quantiles(df, [value], [(k - 1) / max(n - 1, 1)], []).first()[0][0]
