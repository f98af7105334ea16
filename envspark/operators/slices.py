"""C. Filters, splits and samples; H. semi-join, distinct, top-k, sort.

Filters are plain ``where`` predicates so Catalyst pushes them into the
parquet scan (or into partition pruning when the prepared table is
partitioned by year).  Large membership lists use a ``left_semi`` join
instead of a literal IN list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from envspark.functions.quantiles import kth_value
from envspark.session import materialize, one_row


def slice_observations(df: DataFrame, regions: Sequence[str] | DataFrame, year_from: int, year_to: int,
                       cities: Sequence[str] | DataFrame | None = None, years: DataFrame | None = None) -> DataFrame:
    """C1 + H2: region IN list AND year BETWEEN; the city filter applies only
    when the list is non-empty; an empty region list gives no rows.  A
    DataFrame list is applied as a left-semi join (no driver-side list); a
    list of ``years`` prunes the partitions of a table written by year at run
    time."""
    out = df.where(F.col("annee").between(year_from, year_to))
    if years is not None:
        out = out.join(years.select(F.col(years.columns[0]).alias("annee")), "annee", "left_semi")
    if isinstance(regions, DataFrame):
        out = out.join(regions.select(F.col(regions.columns[0]).alias("region")), "region", "left_semi")
    elif regions:
        out = out.where(F.col("region").isin(list(regions)))
    else:
        out = out.where(F.lit(False))
    if isinstance(cities, DataFrame):
        out = out.join(cities.select(F.col(cities.columns[0]).alias("ville")), "ville", "left_semi")
    elif cities:
        out = out.where(F.col("ville").isin(list(cities)))
    return out


def filter_values(df: DataFrame, regions: Sequence[str] | None = None) -> DataFrame:
    """C2 + H4: sorted distinct non-missing regions, cities (within the
    selected regions) and years, as (kind, value) rows."""
    reg = df.where(F.col("region").isNotNull()).select(F.lit("region").alias("kind"),
                                                       F.col("region").alias("value")).distinct()
    cities = df if not regions else df.where(F.col("region").isin(list(regions)))
    cit = cities.where(F.col("ville").isNotNull()).select(F.lit("ville").alias("kind"),
                                                          F.col("ville").alias("value")).distinct()
    yrs = df.where(F.col("annee").isNotNull()).select(F.lit("annee").alias("kind"),
                                                      F.col("annee").cast("string").alias("value")).distinct()
    return reg.unionByName(cit).unionByName(yrs)


def temporal_split(df: DataFrame, test_years: int = 1) -> DataFrame:
    """cutoff = max(year) - test_years; 'train' <= cutoff < 'test';
    a missing year goes to neither side (T26).  One-row cutoff broadcast."""
    cut = df.agg((F.max("annee") - F.lit(test_years)).alias("_cut"))
    j = df.crossJoin(F.broadcast(cut))
    return j.withColumn("split", F.when(F.col("annee") <= F.col("_cut"), F.lit("train"))
                        .when(F.col("annee") > F.col("_cut"), F.lit("test"))).drop("_cut")


def year_cutoff(df: DataFrame, test_years: int = 1) -> int | None:
    """The last training year, one number read from the year column."""
    last = df.agg(F.max("annee")).first()[0]
    return None if last is None else last - test_years


def train_rows(df: DataFrame, cutoff: int | None) -> DataFrame:
    """Training rows; the year is a literal, so a table partitioned by
    year is read for these years only."""
    return df.where(F.lit(False) if cutoff is None else F.col("annee") <= cutoff)


def test_rows(df: DataFrame, cutoff: int | None) -> DataFrame:
    """Test rows, with the same pruning."""
    return df.where(F.lit(False) if cutoff is None else F.col("annee") > cutoff)


def validation_boundary(train: DataFrame, fraction: float = 0.85, min_validation: int = 20,
                        city: str = "ville", key: str = "identifiant") -> DataFrame:
    """One row: where the first int(fraction * n) rows in (city, date, key)
    order end -- the city, the date and the number of rows inside that
    (city, date) cell that still fit -- and whether validation is used.

    Rows are counted per city, then per date of the boundary city: two small
    aggregates with map-side combining.  Nothing depends on how rows are
    partitioned and the data are not sorted."""
    n = F.count(F.lit(1)).alias("_n")
    cities = train.groupBy(F.col(city).alias("_city")).agg(n)
    by_city = Window.orderBy(F.col("_city").asc_nulls_last())                    # one row per city
    placed = cities.withColumn("_upto", F.sum("_n").over(by_city)).crossJoin(
        F.broadcast(cities.agg(F.sum("_n").alias("_tot"))))
    k = F.greatest(F.floor(F.col("_tot") * F.lit(fraction)).cast("long"), F.lit(1))
    edge_city = one_row(placed.where((F.col("_upto") - F.col("_n") < k) & (k <= F.col("_upto"))).select(
        "_city", (k - F.col("_upto") + F.col("_n")).alias("_rest"), (F.col("_tot") - k > min_validation).alias("_use")))
    dates = train.join(F.broadcast(edge_city), F.col(city).eqNullSafe(F.col("_city"))) \
        .groupBy("_city", "_rest", "_use", F.col("date").alias("_date")).agg(n)
    by_date = Window.partitionBy("_city").orderBy(F.col("_date").asc_nulls_last())     # one row per date of one city
    days = dates.withColumn("_upto", F.sum("_n").over(by_date))
    return one_row(days.where((F.col("_upto") - F.col("_n") < F.col("_rest")) & (F.col("_rest") <= F.col("_upto")))
                   .select("_city", "_date", (F.col("_rest") - F.col("_upto") + F.col("_n")).alias("_in_cell"), F.col("_n").alias("_cell_rows"), "_use"))


def nth_place(rows: DataFrame, cols: Sequence[str], k: int) -> list:
    """The values of the ``k``-th row (from 1) in the order of non-missing
    numeric columns: column by column, the k-th smallest value by counts per
    value range, then only the rows that share it.  Nothing is sorted or
    numbered; columns after the one that decides are 0."""
    out: list = []
    for i, c in enumerate(cols):
        n = rows.count()
        v = kth_value(rows, c, k, n)
        out.append(v)
        k -= rows.where(F.col(c) < v).count()
        rows = rows.where(F.col(c) == v)
        if k >= rows.count():             # all that share it come first: later columns need not be looked at
            return out + [float("inf")] * (len(cols) - i - 1)
    return out


def validation_split(train: DataFrame, fraction: float = 0.85, min_validation: int = 20,
                     city: str = "ville", key: str = "identifiant") -> DataFrame:
    """C4: the first int(fraction * n) training rows in (city, date, key) order
    fit, the rest validate (only if more than ``min_validation`` rows would).

    A row is compared with the one boundary row.  Where the boundary lies inside
    a (city, date) cell, its rows are written with a row number and compared
    with the boundary's (key, row number); rows of equal or missing key are told
    apart by that number alone."""
    edge = validation_boundary(train, fraction, min_validation, city, key)
    e = edge.first()
    if e is None or not e["_use"]:
        return train.withColumn("is_validation", F.lit(False))
    j = train.crossJoin(F.broadcast(edge))
    own, day = F.col(city), F.col("date")
    same_city, same_day = own.eqNullSafe(F.col("_city")), day.eqNullSafe(F.col("_date"))
    # nulls are last
    later_city = F.col("_city").isNotNull() & (own.isNull() | (own > F.col("_city")))
    later_day = F.col("_date").isNotNull() & (day.isNull() | (day > F.col("_date")))
    later = F.coalesce(later_city | (same_city & later_day), F.lit(False))
    drop = ["_city", "_date", "_in_cell", "_cell_rows", "_use"]
    if e["_in_cell"] == e["_cell_rows"]:
        return j.withColumn("is_validation", later).drop(*drop)
    in_cell = same_city & same_day
    cell = materialize(j.where(in_cell).drop(*drop).withColumn("_row", F.monotonically_increasing_id()), "boundary-cell")
    # a 64-bit key in two parts that a double holds exactly
    k = F.coalesce(F.col(key).cast("long"), F.lit(0))
    place = [F.col(key).isNull().cast("double"), F.shiftright(k, 32).cast("double"), k.bitwiseAND(0xFFFFFFFF).cast("double"),
             F.shiftright("_row", 33).cast("double"), F.col("_row").bitwiseAND((1 << 33) - 1).cast("double")]
    names = [f"_p{i}" for i in range(len(place))]
    cell = cell.withColumns(dict(zip(names, place, strict=True)))
    last = nth_place(cell.select(*names), names, e["_in_cell"])
    flag = F.struct(*names) > F.struct(*[F.lit(x).alias(n) for n, x in zip(names, last, strict=True)])
    rest = j.where(~in_cell).withColumn("is_validation", later).drop(*drop)
    return rest.unionByName(cell.withColumn("is_validation", flag).drop("_row", *names))


def sample_n(df: DataFrame, n: int = 2000, seed: int = 42, key: str = "identifiant") -> DataFrame:
    """Exactly min(n, rows) rows without replacement, reproducible: ordered
    by the MD5 of row key and seed (TakeOrderedAndProject, no full sort)."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), F.col(key)).limit(n)


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    """H5/H6: multi-key sort + limit with an explicit tie-break."""
    return df.orderBy(*order).limit(k)
