"""Imputation, scaling, encoding, splits and folds."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.functions.columns import as_double, ref
from tablewright.functions.session import small_side
from tablewright.operators.quantiles import exact_quantiles
from tablewright.operators.stats import add_moments, basic_stats

SEED = 42
# One indicator column per category must stay a sane schema.
MAX_INDICATORS = 1_000
HIGH_BITS = 65_536


def column_modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest on a tie.

    Values are counted per column before any two are compared, so a hot value is
    combined map-side and no task sees a whole column.
    """
    out = {}
    for c in columns:
        top = (df.where(ref(c).isNotNull()).groupBy(ref(c).alias("v")).agg(F.count("*").alias("n"))
               .orderBy(F.desc("n"), "v").limit(1).collect())
        out[c] = top[0]["v"] if top else None
    return out


@dataclass
class NumericPrep:
    """Median fill and population-std scaling of numeric columns."""
    medians: dict[str, float]
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)

    def filled(self, df: DataFrame, c: str) -> Column:
        return F.coalesce(as_double(df, c), F.lit(self.medians[c]))

    def scaled(self, df: DataFrame, c: str) -> Column:
        return (self.filled(df, c) - F.lit(self.means[c])) / F.lit(self.scales[c])


def fit_numeric(df: DataFrame, columns: list[str]) -> NumericPrep:
    """Medians, and mean and std of the filled columns, from the unfilled columns' sums."""
    slim = df.select(*[as_double(df, c).alias(c) for c in columns])
    stats = basic_stats(slim) if columns else {}
    add_moments(slim, stats, columns)
    halves = exact_quantiles(slim, columns, [0.5], {
        c: (stats[c].n, stats[c].low, stats[c].high) for c in columns}) if columns else {}
    prep = NumericPrep({c: halves[c][0] for c in columns})
    for c in columns:
        s, median = stats[c], prep.medians[c]
        if not s.n:
            prep.means[c], prep.scales[c] = 0.0, 1.0
            continue
        gaps = s.rows - s.n
        mean = (s.mean * s.n + median * gaps) / s.rows
        squares = (s.m2 or 0.0) + s.n * (s.mean - mean) ** 2 + gaps * (median - mean) ** 2
        flat = s.constant and (not gaps or median == s.low)
        prep.means[c] = mean
        prep.scales[c] = (0.0 if flat else math.sqrt(squares / s.rows)) or 1.0
    return prep


def impute_median(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    prep = fit_numeric(df if fit_on is None else fit_on, columns)
    return df.withColumns({c: prep.filled(df, c) for c in columns})


def impute_mode(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    modes = column_modes(df if fit_on is None else fit_on, columns)
    return df.withColumns({c: F.coalesce(ref(c), F.lit(v).cast(df.schema[c].dataType))
                           for c, v in modes.items()})


def standardise(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None,
                prefix: str = "num__") -> DataFrame:
    """Median-filled, z-scored copies of the columns; a constant column is only centred."""
    prep = fit_numeric(df if fit_on is None else fit_on, columns)
    return df.withColumns({prefix + c: prep.scaled(df, c) for c in columns})


def categories(df: DataFrame, column: str, limit: int = MAX_INDICATORS) -> list:
    """Sorted distinct values; refuses a column with more than `limit` of them."""
    rows = (df.where(ref(column).isNotNull()).select(ref(column).alias("v")).distinct()
            .limit(limit + 1).collect())
    if len(rows) > limit:
        raise ValueError(f"{column} has over {limit} categories; use the sparse model pipeline")
    return sorted(r["v"] for r in rows)


def one_hot(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None,
            prefix: str = "cat__") -> DataFrame:
    """0/1 column per category seen while fitting; an unseen value gives zeros only."""
    source = df if fit_on is None else fit_on
    wide = {f"{prefix}{c}_{v}": F.coalesce((ref(c) == F.lit(v)).cast("int"), F.lit(0))
            for c in columns for v in categories(source, c)}
    return df.withColumns(wide) if wide else df


# Splits and folds: rows are ordered by a hash of their key, so membership depends on
# the data alone and not on how it is partitioned.

def key_hash(keys: list[str], seed: int = SEED) -> Column:
    """First 60 bits of the MD5 of seed and key, as a BIGINT."""
    text = F.concat_ws("|", F.lit(str(seed)), *[ref(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _cut_values(hashed: DataFrame, places: list[Column]) -> DataFrame:
    """(label, cut, h): the hash of the last row before each place in every label's order.

    A place counts the label's rows that come first and is an expression over `total`. Counts
    by the high 16 bits find the bucket, counts by whole hash within that bucket find the
    value, so a task holds 65,536 counts or one 65,536th of a label's rows.
    """
    label = Window.partitionBy("label")
    buckets = hashed.groupBy("label", "hi").agg(F.count("*").alias("n"))
    buckets = (buckets.withColumn("upto", F.sum("n").over(label.orderBy("hi")))
               .withColumn("total", F.sum("n").over(label)))
    cuts = F.array(*[F.struct(F.lit(i).alias("cut"), p.cast("bigint").alias("place"))
                     for i, p in enumerate(places)])
    hit = small_side(
        buckets.select("label", "hi", "n", "upto", F.inline(cuts))
        .where((F.col("upto") - F.col("n") < F.col("place")) & (F.col("place") <= F.col("upto")))
        .select(F.col("label").alias("b_label"), F.col("hi").alias("b_hi"), "cut", "place",
                (F.col("upto") - F.col("n")).alias("before")))
    inside = (hashed.join(hit, F.col("label").eqNullSafe(F.col("b_label"))
                          & (F.col("hi") == F.col("b_hi")))
              .groupBy("label", "cut", "place", "before", "h").agg(F.count("*").alias("n")))
    order = Window.partitionBy("label", "cut").orderBy("h")
    return (inside.withColumn("upto", F.col("before") + F.sum("n").over(order))
            .where(F.col("upto") >= F.col("place"))
            .groupBy("label", "cut").agg(F.min("h").alias("cut_h")))


def _with_cut_count(df: DataFrame, keys: list[str], label: str | None, places: list[Column],
                    out: str, seed: int) -> DataFrame:
    """`out`: how many of the cuts lie before the row in its label's hash order."""
    h = key_hash(keys, seed)
    label_column = ref(label) if label else F.lit(0)
    hashed = df.select(label_column.alias("label"), h.alias("h"),
                       F.shiftright(h, 44).cast("int").alias("hi"))
    cuts = (_cut_values(hashed, places).groupBy("label")
            .agg(F.sort_array(F.collect_list("cut_h")).alias("cuts"),
                 (F.lit(len(places)) - F.count("*")).cast("int").alias("open")))
    if label is None:
        row = cuts.first()
        found, open_cuts = (row["cuts"], row["open"]) if row else ([], len(places))
        passed = sum([(h > F.lit(c)).cast("int") for c in found], F.lit(open_cuts))
        return df.withColumn(out, passed)
    cuts = small_side(cuts.withColumnRenamed("label", "cut_label"))
    joined = df.withColumn("row_h", h).join(cuts, ref(label).eqNullSafe(F.col("cut_label")), "left")
    # A cut at place 0 has no row before it and is counted in `open`.
    passed = F.size(F.filter("cuts", lambda c: F.col("row_h") > c)) + F.col("open")
    return (joined.withColumn(out, F.coalesce(passed, F.lit(len(places))))
            .drop("row_h", "cut_label", "cuts", "open"))


def split(df: DataFrame, keys: list[str], stratify: str | None = None, test_share: float = 0.2,
          seed: int = SEED) -> DataFrame:
    """Adds `split`: the last ceil(share x n) rows in hash order, per class, are 'test'."""
    place = F.col("total") - F.ceil(F.lit(float(test_share)) * F.col("total"))
    marked = _with_cut_count(df, keys, stratify, [place], "split", seed)
    return marked.withColumn("split", F.when(F.col("split") == 1, "test").otherwise("train"))


def folds(df: DataFrame, keys: list[str], stratify: str | None = None, k: int = 5,
          seed: int = SEED) -> DataFrame:
    """Adds `fold` 0..k-1; sizes differ by at most one within a class."""
    total = F.col("total")
    places = [F.floor(total / k) * i + F.least(F.lit(i), F.pmod(total, F.lit(k)))
              for i in range(1, k)]
    return _with_cut_count(df, keys, stratify, places, "fold", seed)


