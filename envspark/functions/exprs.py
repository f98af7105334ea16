"""Column-expression builders (JVM-side, codegen-friendly; no Python UDFs).

These return ``Column`` objects so Catalyst can fold them into a single
projection with the surrounding operators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from envspark import config as C


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """Pandas skips NaN; in Spark only NULL is skipped, so NaN -> NULL."""
    x = col_(c)
    return F.when(~F.isnan(x), x)


def to_number(c: str | Column) -> Column:
    """A5: coercing numeric parse, bad text -> NULL, NaN -> NULL."""
    return nan_to_null(col_(c).try_cast("double"))


def parse_date(c: str | Column) -> Column:
    """A4: coercing date parse (unparsable -> NULL)."""
    x = col_(c)
    return F.coalesce(x.try_cast("date"), F.try_to_timestamp(x.cast("string")).cast("date"))


def clip01(x: Column) -> Column:
    """clip(0, 1) that keeps NULL (T2): greatest/least alone would turn NULL into 1."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def np_round(x: Column, n: int) -> Column:
    """pandas/numpy ``round(n)``: scale, round half to even on the double, unscale."""
    s = 10.0 ** n
    return F.rint(x * F.lit(s)) / F.lit(s) + F.lit(0.0)


def py_round(x: Column, n: int) -> Column:
    """Python's ``round(x, n)`` on a double: half-even on the EXACT binary
    value.  p = x * 10^n is rounded by the multiplication; its exact error e
    comes from an error-free product (Veltkamp split of x, exact partial
    products with the small integer 10^n).  Only when p lands exactly on a
    half can the rounding direction be wrong; the sign of e then decides,
    and an exact tie (e = 0) goes to even."""
    s = F.lit(float(10 ** n))
    p = x * s
    c = F.lit(134217729.0) * x                 # 2^27 + 1
    hi = c - (c - x)
    lo = x - hi
    e = (hi * s - p) + lo * s
    half = (p - F.floor(p)) == F.lit(0.5)
    r = (F.when(half & (e > 0), F.ceil(p).cast("double"))
          .when(half & (e < 0), F.floor(p).cast("double"))
          .otherwise(F.rint(p)))
    return F.when(x.isNotNull(), r / s + F.lit(0.0))


def fin(x: Column, n: int = 6) -> Column:
    """Hash-safe final rounding of float outputs (6 decimals, half-even)."""
    return np_round(x.cast("double"), n)


def band_ordinal(x: Column, edges: Sequence[float] = C.BAND_EDGES) -> Column:
    """1-based ordinal of right-closed bands, lowest edge included.

    Values outside [edges[0], edges[-1]] and NULL give NULL."""
    expr = None
    for i in range(1, len(edges)):
        lo, hi = float(edges[i - 1]), float(edges[i])
        cond = ((x >= F.lit(lo)) if i == 1 else (x > F.lit(lo))) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def label_of(ordinal: Column, labels: Sequence[str]) -> Column:
    """Label of a 1-based ordinal (NULL stays NULL); a CASE chain, not
    element_at, so a NULL ordinal can never be read as index 0."""
    expr = None
    for i, s in enumerate(labels, start=1):
        expr = F.when(ordinal == i, F.lit(s)) if expr is None else expr.when(ordinal == i, F.lit(s))
    return expr


def band_label(x: Column, labels: Sequence[str], edges: Sequence[float] = C.BAND_EDGES) -> Column:
    return label_of(band_ordinal(x, edges), labels)


def class_label(x: Column) -> Column:
    return (F.when(x == 0, F.lit(C.CLASS_LABELS[0]))
             .when(x == 1, F.lit(C.CLASS_LABELS[1])))


def level_expr(x: Column, cfg: C.TargetConfig) -> Column:
    """level label of a value under a target config (NULL if none)."""
    if cfg.is_classification:
        return class_label(x)
    if cfg.edges and cfg.band_labels:
        return band_label(x, cfg.band_labels, cfg.edges)
    return F.lit(None).cast("string")


def wind_sector_ordinal(deg: Column) -> Column:
    """F2: 16 right-closed 22.5-degree sectors starting at 0 (N = [0, 22.5])."""
    d = F.pmod(deg, F.lit(360.0))
    return F.when(d.isNotNull(),
                  F.greatest(F.lit(1), F.ceil(d / F.lit(C.WIND_SECTOR_WIDTH)).cast("int")))


def wind_sector(deg: Column) -> Column:
    return label_of(wind_sector_ordinal(deg), C.WIND_SECTOR_LABELS)


def wind_regime(deg: Column, month: Column) -> Column:
    """Harmattan / Mousson / Autre from direction (mod 360) and month."""
    d = F.pmod(deg, F.lit(360.0))
    return (F.when(month.isin(*C.HARMATTAN_MONTHS) & ((d >= 315) | (d <= 90)), F.lit(C.REGIME_HARMATTAN))
             .when(month.isin(*C.MOUSSON_MONTHS) & (d >= 135) & (d <= 270), F.lit(C.REGIME_MOUSSON))
             .otherwise(F.lit(C.REGIME_OTHER)))


def month_label(m: Column) -> Column:
    """French month label; unknown month -> its string."""
    mi = m.cast("int")
    expr = None
    for k, name in C.MONTH_NAMES.items():
        expr = F.when(mi == k, F.lit(name)) if expr is None else expr.when(mi == k, F.lit(name))
    return expr.otherwise(m.cast("string"))


def bound_rule(name: str) -> str:
    """B11 rule for a column name, tested in the reference's order."""
    if C.BOUND_PERCENT_TOKEN in name:
        return "percent"
    if C.BOUND_ANGLE_TOKEN in name:
        return "angle"
    if any(tok in name for tok in C.BOUND_NONNEG_TOKENS):
        return "nonneg"
    return "none"


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation, pairwise complete, NULL for a constant side."""
    both = a.isNotNull() & b.isNotNull()
    aa, bb = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(aa, bb),
                        F.nullif(F.stddev_pop(aa) * F.stddev_pop(bb), F.lit(0.0)))
