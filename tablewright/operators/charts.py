"""The numbers behind charts: histogram, scatter, bar, box and correlation bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.functions.columns import as_double, numeric_columns, ref
from tablewright.functions.tables import small_table
from tablewright.operators.profile import Profile, fences
from tablewright.operators.quantiles import exact_quantiles, value_extents

HISTOGRAM_BINS = 20


def _bin(x, low: float, high: float, bins: int):
    if low == high:
        return F.lit(0)
    position = F.floor((x - F.lit(low)) / F.lit(high - low) * bins)
    return F.greatest(F.least(position, F.lit(bins - 1)), F.lit(0)).cast("int")


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(bin, low, high, n) over equal-width bins, empty ones included."""
    spark = df.sparkSession
    n, low, high = value_extents(df, [column])[column]
    schema = "bin int, low double, high double, n long"
    if not n:
        return small_table(spark, [], schema)
    x = as_double(df, column)
    counted = df.where(x.isNotNull()).groupBy(_bin(x, low, high, bins).alias("bin")).agg(
        F.count("*").alias("n"))
    width = (high - low) / bins
    found = {r["bin"]: r["n"] for r in counted.collect()}  # at most `bins` rows
    return small_table(spark, [(b, low + b * width, low + (b + 1) * width, found.get(b, 0))
                               for b in range(bins)], schema)


def scatter_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """Every (x, y) pair."""
    return df.select(as_double(df, x).alias("x"), as_double(df, y).alias("y"))


def scatter_density(df: DataFrame, x: str, y: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(x_bin, y_bin, n) of all pairs; the drawable form of a large scatter."""
    extents = value_extents(df, [x, y])
    points = scatter_points(df, x, y).where("x is not null and y is not null")
    if not extents[x][0] or not extents[y][0]:
        return points.select(F.lit(0).alias("x_bin"), F.lit(0).alias("y_bin"),
                             F.lit(0).cast("bigint").alias("n")).where("false")
    return (points.groupBy(_bin(F.col("x"), *extents[x][1:], bins).alias("x_bin"),
                           _bin(F.col("y"), *extents[y][1:], bins).alias("y_bin"))
            .agg(F.count("*").alias("n")))


def bar(df: DataFrame, label: str, value: str | None = None, top: int | None = None) -> DataFrame:
    """(label, value): row count or sum per label, largest first when cut to `top`."""
    measure = F.sum(as_double(df, value)) if value else F.count("*")
    out = df.groupBy(ref(label).alias("label")).agg(measure.alias("value"))
    return out.orderBy(F.desc("value"), "label").limit(top) if top else out


def box_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Five numbers, whisker ends inside the 1.5 IQR fences and outlier count per column."""
    names = columns or numeric_columns(df)
    extents = value_extents(df, names)
    names = [c for c in names if extents[c][0]]
    quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75], extents)
    tests = []
    for c in names:
        low, high = fences(quartiles[c])
        x = as_double(df, c)
        inside = x.between(F.lit(low), F.lit(high))
        tests += [F.min(F.when(inside, x)), F.max(F.when(inside, x)), F.count(F.when(~inside, 1))]
    row = df.agg(*tests).first() if tests else []
    rows = [(c, extents[c][1], *quartiles[c], extents[c][2], *row[3 * i:3 * i + 3])
            for i, c in enumerate(names)]
    return small_table(df.sparkSession, rows,
                       "column string, min double, q25 double, median double, q75 double, max double, "
                       "whisker_low double, whisker_high double, outliers long")


def correlation_bands(df: DataFrame, target: str | None = None) -> DataFrame:
    """Correlation matrix with the colour band of each cell."""
    val = F.col("val")
    band = (F.when(val > 0.7, "strong").when(val > 0.3, "medium")
            .when(val < -0.3, "negative").otherwise("weak"))
    return Profile(df, target).correlation_matrix().withColumn("band", band)
