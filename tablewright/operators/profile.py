"""Dataset profile: every section is a projection of a few shared statistics passes."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, Window, functions as F

from tablewright.functions.columns import (
    FIXED_WIDTHS, as_double, chunks, families, numeric_columns, ref, scrub_nonfinite)
from tablewright.functions.tables import half_up, small_table
from tablewright.operators import stats as S
from tablewright.operators.quantiles import exact_quantiles

# Name patterns of the target guess, current and older rule set.
TARGET_NAMES = {
    "current": r"target|label|class|outcome|y|result|status|pred|dependent|species|category",
    "v0": r"target|label|class|outcome|y|result|status|pred|dependent",
}
IDENTIFIER_NAMES = {
    "current": r"id|uuid|index|key|name|serial|date|time|timestamp",
    "v0": r"id|uuid|index|key|name|serial|date|time",
}
# Thresholds of the profile.
HIGH_MISSING = 0.4
HIGH_CORRELATION = 0.8
Z_LIMIT = 2.5
FENCE = 1.5
SAMPLE_CAP = 20
RISK_WEIGHTS = (0.3, 0.2, 0.2, 0.2, 0.1)


class Profile:
    """Profile of one table.

    `target` is left out of the feature sections, `key` names the columns that identify
    a row in the outlier samples. `approx` counts distinct values with HyperLogLog.
    """

    def __init__(self, df: DataFrame, target: str | None = None, key: list[str] | str | None = None,
                 approx: bool = False):
        self.df = scrub_nonfinite(df)
        self.spark = df.sparkSession
        self.target = target
        self.key = [key] if isinstance(key, str) else list(key or [])
        self.approx = approx
        self.families = families(df)
        self.numerics = numeric_columns(df)
        self.features = [c for c in df.columns if c != target]
        self.feature_numerics = [c for c in self.numerics if c != target]

    # Shared statistics, each computed once.

    @cached_property
    def basic(self) -> dict[str, S.ColumnStats]:
        return S.basic_stats(self.df)

    @cached_property
    def stats(self) -> dict[str, S.ColumnStats]:
        S.add_moments(self.df, self.basic, self.numerics)
        return self.basic

    @cached_property
    def rows(self) -> int:
        return next(iter(self.basic.values())).rows if self.basic else 0

    @cached_property
    def correlations(self) -> dict[tuple[str, str], float | None]:
        return S.pair_correlations(self.df, self.stats, self.numerics)

    @cached_property
    def _distinct(self) -> dict[str, int]:
        return {}

    def distinct(self, columns) -> dict[str, int]:
        """Distinct non-null counts, remembered between sections."""
        missing = [c for c in columns if c not in self._distinct]
        if missing:
            self._distinct.update(S.distinct_counts(self.df, missing, self.approx))
        return {c: self._distinct[c] for c in columns}

    @cached_property
    def quartiles(self) -> dict[str, list[float | None]]:
        extents = {c: (self.basic[c].n, self.basic[c].low, self.basic[c].high)
                   for c in self.numerics}
        return exact_quantiles(self.df, self.numerics, [0.25, 0.5, 0.75], extents)

    @cached_property
    def flags(self) -> dict[str, object]:
        """Column -> z-score outlier condition, for columns with spread."""
        out = {}
        for c in self.feature_numerics:
            s = self.stats[c]
            if s.std:
                z = (as_double(self.df, c) - F.lit(s.mean)) / F.lit(s.std)
                out[c] = F.abs(z) > F.lit(Z_LIMIT)
        return out

    @cached_property
    def outliers(self) -> dict[str, tuple[int, float]]:
        """Flagged columns only: column -> (count, share of non-null values)."""
        out = {}
        for part in chunks(list(self.flags), S.SUMS_PER_PASS):
            row = self.df.agg(*[F.count(F.when(self.flags[c], 1)) for c in part]).first()
            out.update({c: (n, half_up(n / self.stats[c].n, 4)) for c, n in zip(part, row) if n})
        return out

    def _table(self, rows, schema: str) -> DataFrame:
        return small_table(self.spark, rows, schema)

    # Sections.

    def metadata(self) -> DataFrame:
        """Rows, columns and bytes of data: string octets plus fixed widths."""
        size = 0
        for f in self.df.schema.fields:
            s = self.basic[f.name]
            size += s.octets if s.octets is not None else \
                self.rows * FIXED_WIDTHS.get(f.dataType.simpleString(), 0)
        return self._table([(self.rows, len(self.df.columns), size)],
                           "num_rows long, num_columns long, data_bytes long")

    @cached_property
    def kinds(self) -> dict[str, str]:
        """Feature -> numerical, categorical, boolean, datetime, text or unsupported."""
        strings = [c for c in self.features if self.families[c] == "string"]
        distinct = self.distinct(strings)
        out = {}
        for c in self.features:
            kind = self.families[c]
            if kind == "numeric":
                kind = "numerical"
            elif kind == "string":
                few = distinct[c] < 20 or (self.rows and distinct[c] / self.rows < 0.1)
                kind = "categorical" if few else "text"
            out[c] = kind
        return out

    def feature_types(self) -> DataFrame:
        return self._table(list(self.kinds.items()), "column string, kind string")

    def missing(self) -> DataFrame:
        return self._table([(c, s.null_fraction) for c, s in self.basic.items()],
                           "column string, null_fraction double")

    def high_missing(self) -> DataFrame:
        return self.missing().where(F.col("null_fraction") > HIGH_MISSING)

    @cached_property
    def target_type(self) -> str | None:
        if self.target not in self.families:
            return None
        numeric = self.families[self.target] in ("numeric", "boolean")
        few = self.distinct([self.target])[self.target] < 15
        return "classification" if not numeric or few else "regression"

    def class_distribution(self) -> DataFrame:
        """Share of each non-null class."""
        counts = (self.df.where(ref(self.target).isNotNull())
                  .groupBy(ref(self.target).cast("string").alias("class")).agg(F.count("*").alias("n")))
        return counts.withColumn("share", F.col("n") / F.lit(self.basic[self.target].n))

    @cached_property
    def imbalance(self) -> float | None:
        """Smallest class share."""
        if self.target_type != "classification" or not self.basic[self.target].n:
            return None
        return self.class_distribution().agg(F.min("share")).first()[0]

    def target_analysis(self) -> DataFrame:
        schema = ("target_type string, num_unique long, imbalance_ratio double, "
                  "mean double, std double, skewness double")
        if self.target_type is None:
            return self._table([], schema)
        s = self.stats[self.target]
        row = [self.target_type, self.distinct([self.target])[self.target], self.imbalance]
        row += [None] * 3 if self.target_type == "classification" else [s.mean, s.std, s.skewness]
        return self._table([tuple(row)], schema)

    def numeric_summary(self) -> DataFrame:
        rows = []
        for c in self.feature_numerics:
            s = self.stats[c]
            values = [s.mean, s.std, s.low, s.high, s.skewness, self.quartiles[c][1]]
            rows.append((c, *[half_up(v, 4) for v in values]))
        return self._table(rows, "column string, mean double, std double, min double, max double, "
                                 "skewness double, median double")

    def extended_summary(self) -> DataFrame:
        """The older summary: range and kurtosis too, unrounded."""
        rows = []
        for c in self.feature_numerics:
            s = self.stats[c]
            spread = s.high - s.low if s.n else None
            rows.append((c, s.mean, s.std, s.low, s.high, spread, s.skewness, s.kurtosis,
                         self.quartiles[c][1]))
        return self._table(rows, "column string, mean double, std double, min double, max double, "
                                 "range double, skewness double, kurtosis double, median double")

    def correlation(self, a: str, b: str) -> float | None:
        if a == b:
            s = self.stats[a]
            return 1.0 if s.std else None
        return self.correlations[(a, b) if (a, b) in self.correlations else (b, a)]

    def correlation_matrix(self) -> DataFrame:
        """Long form of the full matrix; empty below two numeric features."""
        names = self.feature_numerics if len(self.feature_numerics) > 1 else []
        rows = [(c, r, half_up(self.correlation(c, r), 2)) for c in names for r in names]
        return self._table(rows, "col string, row string, val double")

    def high_correlation_pairs(self) -> DataFrame:
        rows = [(a, b, half_up(abs(r), 4)) for (a, b), r in self.correlations.items()
                if r is not None and abs(r) > HIGH_CORRELATION]
        return self._table(rows, "f1 string, f2 string, val double")

    def cardinality(self) -> DataFrame:
        names = [c for c in self.features if self.families[c] not in ("numeric", "unsupported")]
        return self._table(list(self.distinct(names).items()), "column string, num_unique long")

    def outlier_summary(self) -> DataFrame:
        return self._table([(c, n, pct) for c, (n, pct) in self.outliers.items()],
                           "column string, count long, pct double")

    def outlier_samples(self, cap: int = SAMPLE_CAP) -> DataFrame:
        """The first `cap` flagged rows of each column in key order."""
        if not self.key:
            raise ValueError("outlier samples need key columns")
        keys = [ref(k) for k in self.key]
        hits = F.array(*[F.when(self.flags[c], F.lit(c)) for c in self.outliers]) \
            if self.outliers else F.array().cast("array<string>")
        flagged = (self.df.select(*keys, F.explode(hits).alias("column"))
                   .where(F.col("column").isNotNull()))
        place = F.row_number().over(Window.partitionBy("column").orderBy(*keys))
        return flagged.withColumn("place", place).where(F.col("place") <= cap)

    def iqr_outliers(self) -> DataFrame:
        """The older summary: share of values outside the 1.5 IQR fences, zero included."""
        live = [c for c in self.feature_numerics if self.basic[c].n]
        rows = []
        for part in chunks(live, S.SUMS_PER_PASS):
            tests = []
            for c in part:
                low, high = fences(self.quartiles[c])
                x = as_double(self.df, c)
                tests.append(F.count(F.when((x < F.lit(low)) | (x > F.lit(high)), 1)))
            row = self.df.agg(*tests).first()
            rows += [(c, n / self.basic[c].n) for c, n in zip(part, row)]
        return self._table(rows, "column string, outlier_pct double")

    @cached_property
    def mutual_information(self) -> float:
        """Stand-in for mutual information: mean |r| of the target with the numeric features."""
        if not self.target:
            return 0.5
        if self.target not in self.numerics:
            return 0.4
        rs = [self.correlation(self.target, c) for c in self.feature_numerics]
        rs = [abs(r) for r in rs if r is not None]
        return min(sum(rs) / len(rs), 1.0) if rs else 0.3

    @cached_property
    def risk(self) -> dict[str, float]:
        """Overfitting risk index and its five parts, unrounded."""
        ratio = min(len(self.features) / self.rows, 1.0) if self.rows else 1.0
        imbalance = 0.0
        if self.imbalance is not None and self.imbalance < 0.5:
            imbalance = 1.0 - 2.0 * self.imbalance
        rs = list(self.correlations.values())
        mean_corr = sum(abs(r) for r in rs) / len(rs) if rs and None not in rs else 0.0
        noise = sum(pct for _, pct in self.outliers.values()) / max(len(self.outliers), 1)
        parts = [ratio, imbalance, 1.0 - self.mutual_information, mean_corr, noise]
        score = min(max(sum(w * p for w, p in zip(RISK_WEIGHTS, parts)), 0.0), 1.0)
        names = ["score", "d_n_ratio", "imbalance", "one_minus_mi", "mean_corr", "noise_proxy"]
        return dict(zip(names, [score] + parts))

    def overfitting_risk(self) -> DataFrame:
        return self._table([tuple(half_up(v, 4) for v in self.risk.values())],
                           ", ".join(f"{n} double" for n in self.risk))

    def _target_score(self, c: str, position: int, rules: str) -> float:
        s, distinct = self.stats[c], self.distinct([c])[c]
        name, score = c.lower(), 0.0
        if re.search(TARGET_NAMES[rules], name):
            score += 5
        if re.search(IDENTIFIER_NAMES[rules], name):
            score -= 4
        if s.family == "string":
            score += 3 if distinct <= 50 else -2
        elif s.family in ("numeric", "boolean"):
            score += 2 if distinct <= 20 else 1
            if s.family == "numeric" and s.std == 0:
                score -= 5
        if position in (0, len(self.df.columns) - 1):
            score += 1
        score -= 2 * s.null_fraction
        if distinct / s.rows > 0.9:
            score -= 3
        return score

    def scored_targets(self, rules: str = "current") -> list[tuple[str, float]]:
        usable = [c for c in self.df.columns if self.families[c] != "unsupported"]
        distinct = self.distinct(usable)
        scored = [(c, self._target_score(c, i, rules)) for i, c in enumerate(self.df.columns)
                  if distinct.get(c, 0) > 1 and self.basic[c].null_fraction <= 0.8]
        return sorted(scored, key=lambda pair: -pair[1])

    def target_candidates(self, rules: str = "current", min_confidence: float | None = None) -> DataFrame:
        """Ranked guesses; nothing when the best one's confidence is not above the minimum."""
        ranked = self.scored_targets(rules)
        confidence = min(max(ranked[0][1] / 8, 0.0), 1.0) if ranked else 0.0
        if min_confidence is not None and not confidence > min_confidence:
            ranked = []
        rows = [(i + 1, c, score, confidence) for i, (c, score) in enumerate(ranked)]
        return self._table(rows, "place int, column string, score double, confidence double")

    def describe(self) -> DataFrame:
        rows = []
        for c in self.numerics:
            s = self.stats[c]
            rows.append((c, s.n, s.mean, s.std, s.low, *self.quartiles[c], s.high))
        return self._table(rows, "column string, count long, mean double, std double, min double, "
                                 "q25 double, q50 double, q75 double, max double")

    def schema(self) -> DataFrame:
        return self._table([(i + 1, c, t) for i, (c, t) in enumerate(self.df.dtypes)],
                           "position int, column string, dtype string")

    def full(self) -> DataFrame:
        """Every section as (section, column, metric, value, label)."""
        def numbers(section, table, name, *metrics):
            pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                     for m in metrics]
            return (table.select(name.alias("column"), F.inline(F.array(*pairs)))
                    .select(F.lit(section).alias("section"), "column", "metric", "value",
                            F.lit(None).cast("string").alias("label")))

        whole, column = F.lit(None).cast("string"), F.col("column")
        kinds = self.feature_types().select(
            F.lit("feature_types").alias("section"), "column", F.lit("kind").alias("metric"),
            F.lit(None).cast("double").alias("value"), F.col("kind").alias("label"))
        parts = [
            numbers("metadata", self.metadata(), whole, "num_rows", "num_columns", "data_bytes"),
            kinds,
            numbers("missing", self.missing(), column, "null_fraction"),
            numbers("numerical_summary", self.numeric_summary(), column,
                    "mean", "std", "min", "max", "skewness", "median"),
            numbers("correlation_matrix", self.correlation_matrix().withColumn(
                "column", F.concat_ws("~", "col", "row")), column, "val"),
            numbers("correlation_summary", self.high_correlation_pairs().withColumn(
                "column", F.concat_ws("~", "f1", "f2")), column, "val"),
            numbers("categorical_cardinality", self.cardinality(), column, "num_unique"),
            numbers("outlier_summary", self.outlier_summary(), column, "count", "pct"),
            numbers("overfitting_risk_index", self.overfitting_risk(), whole, *self.risk),
        ]
        if self.target_type:
            target = self.target_analysis().withColumn("column", F.lit(self.target))
            parts.append(numbers("target_analysis", target, column, "num_unique",
                                 "imbalance_ratio", "mean", "std", "skewness")
                         .withColumn("label", F.lit(self.target_type)))
        if self.target_type == "classification":
            parts.append(numbers("class_distribution", self.class_distribution(),
                                 F.col("class"), "share"))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def fences(quartiles: list[float]) -> tuple[float, float]:
    """1.5 IQR fences around the quartiles."""
    q1, _, q3 = quartiles
    return q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1)
