import datetime
import math
import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from conftest import rows_of
from tablewright.operators import stats as S
from tablewright.operators.profile import Profile
from tablewright.operators.quantiles import exact_quantiles


def close(a, b, tolerance=1e-9):
    if b is None or (isinstance(b, float) and math.isnan(b)):
        return a is None
    return a is not None and abs(a - b) <= tolerance * max(1.0, abs(b))


def test_column_statistics_match_pandas(mixed, clean_mixed):
    profile = Profile(mixed)
    for c in ("a.b", "q`x"):
        s, x = profile.stats[c], clean_mixed[c]
        for got, want in ((s.mean, x.mean()), (s.std, x.std()), (s.low, x.min()), (s.high, x.max()),
                          (s.skewness, x.skew()), (s.kurtosis, x.kurt()), (s.std_pop, x.std(ddof=0))):
            assert close(got, float(want))
        assert s.n == x.count() and close(s.null_fraction, x.isna().mean())


def test_constant_and_empty_columns(mixed):
    stats = Profile(mixed).stats
    assert (stats["const"].std, stats["const"].skewness, stats["const"].kurtosis) == (0.0, 0.0, 0.0)
    assert stats["empty"].mean is None and stats["empty"].std is None and stats["empty"].skewness is None


@pytest.mark.parametrize("rows,skew,kurt", [(1, None, None), (2, None, None), (3, True, None), (4, True, True)])
def test_short_tables(spark, rows, skew, kurt):
    data = [1.0, 5.0, 6.0, 20.0][:rows]
    s = Profile(spark.createDataFrame([(v,) for v in data], "x double")).stats["x"]
    x = pd.Series(data)
    assert close(s.std, float(x.std()))
    assert (s.skewness is None) == (skew is None) and (s.kurtosis is None) == (kurt is None)
    if skew:
        assert close(s.skewness, float(x.skew()))
    if kurt:
        assert close(s.kurtosis, float(x.kurt()))


def test_empty_table(spark):
    profile = Profile(spark.createDataFrame([], "x double, s string"), "s")
    assert profile.metadata().first()["num_rows"] == 0
    assert profile.numeric_summary().first()["mean"] is None
    assert profile.outlier_summary().count() == 0
    assert profile.risk["d_n_ratio"] == 1.0
    assert profile.target_candidates().count() == 0


def test_feature_kinds(mixed, spark):
    assert Profile(mixed, "id").kinds == {
        "a.b": "numerical", "q`x": "numerical", "const": "numerical", "empty": "numerical",
        "flag": "boolean", "naïve": "categorical"}
    many = spark.range(100).selectExpr("concat('v', id) as s", "id % 2 as y", "array(1.0) as v")
    assert Profile(many, "y").kinds == {"s": "text", "v": "unsupported"}


def test_missing_and_high_missing(mixed):
    got = dict(rows_of(Profile(mixed).missing()))
    assert got["a.b"] == 0.4 and got["empty"] == 1.0 and got["naïve"] == 0.1
    assert [r[0] for r in rows_of(Profile(mixed).high_missing())] == ["empty"]


def test_correlations_match_pandas(mixed, clean_mixed):
    profile = Profile(mixed)
    want = clean_mixed[profile.numerics].corr()
    for (a, b), r in profile.correlations.items():
        assert close(r, float(want.loc[a, b])), (a, b)


def test_gram_and_sum_correlations_agree(spark):
    draw = np.random.default_rng(3)
    frame = pd.DataFrame(draw.normal(size=(400, 6)), columns=list("abcdef"))
    frame["g"] = frame["a"] * 2 + 1e6
    frame = frame.mask(draw.random(frame.shape) < 0.1)
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in frame.to_numpy()]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in frame)).repartition(3)
    stats = S.basic_stats(df)
    S.add_moments(df, stats, df.columns)
    sums = S.pair_correlations(df, stats, df.columns)
    gram = S.pair_correlations(df, stats, df.columns, gram_from=2)
    want = frame.corr()
    for pair in sums:
        assert close(sums[pair], want.loc[pair], 1e-9) and close(gram[pair], want.loc[pair], 1e-9)


def test_outliers_and_samples(spark):
    values = [(i, float(i % 5), 1.0) for i in range(60)] + [(60, 500.0, 1.0), (61, -500.0, 1.0)]
    profile = Profile(spark.createDataFrame(values, "id long, x double, c double"), key="id")
    assert profile.outliers == {"x": (2, 0.0323)}
    assert rows_of(profile.outlier_samples(1), "id") == [(60, "x", 1)]
    # Far values on one side only of the fences count too, and a column without spread gives 0.
    assert dict(rows_of(profile.iqr_outliers()))["c"] == 0.0


def test_risk_index_by_hand(spark):
    rows = [(float(i), float(2 * i), i % 2) for i in range(10)]
    profile = Profile(spark.createDataFrame(rows, "a double, b double, y long"), "y")
    parts = profile.risk
    r = abs(np.corrcoef([float(i) for i in range(10)], [i % 2 for i in range(10)])[0, 1])
    assert close(parts["d_n_ratio"], 0.2) and parts["imbalance"] == 0.0
    assert close(parts["one_minus_mi"], 1 - r) and close(parts["mean_corr"], (1 + 2 * r) / 3)
    assert close(parts["score"], 0.3 * 0.2 + 0.2 * (1 - r) + 0.2 * (1 + 2 * r) / 3)


def test_target_scores_by_hand(spark):
    rows = [(i, "abc"[i % 3], float(i % 30), None if i % 2 else 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "row_id long, species string, amount double, half double")
    scores = dict(Profile(df).scored_targets())
    # id: -4, >20 distinct +1, first +1, unique -3. species: name +5, few +3 ("half" is constant).
    assert scores == {"row_id": -5.0, "species": 8.0, "amount": 1.0}
    assert dict(Profile(df).scored_targets("v0"))["species"] == 3.0
    best = Profile(df).target_candidates().first()
    assert (best["column"], best["confidence"]) == ("species", 1.0)
    assert Profile(df).target_candidates("v0", min_confidence=0.6).count() == 0


@pytest.mark.parametrize("keep", [1, 7, 10_000_000])
def test_quantiles_are_exact_however_they_are_narrowed(spark, keep):
    draw = np.random.default_rng(5)
    columns = {
        "skewed": np.exp(draw.normal(0, 4, 3000)),
        "hot": np.where(draw.random(3000) < 0.4, 7.0, draw.normal(0, 1, 3000)),
        "signs": draw.normal(0, 1, 3000) * 10.0 ** draw.integers(-12, 12, 3000),
        "wide": np.where(np.arange(3000) == 5, 1.7e308, np.where(np.arange(3000) == 6, -1.7e308, draw.normal(0, 1, 3000))),
    }
    frame = pd.DataFrame(columns)
    df = spark.createDataFrame(frame)
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df, list(columns), probabilities, keep_rows=keep)
    for c in columns:
        want = frame[c].quantile(probabilities).tolist()
        assert all(close(a, b, 1e-12) for a, b in zip(got[c], want)), c


def test_profile_does_not_depend_on_partitions(spark, mixed):
    one = rows_of(Profile(mixed.repartition(1), "naïve").full(), "section", "column", "metric")
    many = rows_of(Profile(mixed.repartition(7), "naïve").full(), "section", "column", "metric")
    assert one == many


def test_long_text_is_counted_by_digest(spark):
    rows = [("x" * 200 + str(i % 7),) for i in range(50)] + [(None,)]
    profile = Profile(spark.createDataFrame(rows, "s string"))
    assert profile.distinct(["s"]) == {"s": 7}


def test_distinct_counts_of_every_type(spark):
    """Values of all types, nulls, signed zeros and a column without values, against sets; the plan has one Expand-free pass."""
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(40)]), rng.choice([0.0, -0.0, 1.5, float("nan"), None]), rng.choice(["", "a", "A", "ä" * 90, None]),
             rng.random() < 0.5, Decimal(rng.randrange(30)) * Decimal("123456789012345678901"), datetime.date(2020, 1, 1 + rng.randrange(9)),
             datetime.datetime(2020, 1, 1, rng.randrange(5)), rng.randrange(300) * 2**54, None) for _ in range(900)]
    df = spark.createDataFrame(rows, "i int, d double, s string, b boolean, p decimal(38,2), day date, t timestamp, l long, nothing string")
    got = S.distinct_counts(df, df.columns)
    want = {c: len({r[k] for r in rows if r[k] is not None and r[k] == r[k]}) for k, c in enumerate(df.columns)}
    assert got == want and list(got) == df.columns
    assert S.distinct_counts(df.limit(0), ["i", "s"]) == {"i": 0, "s": 0}


def test_distinct_counts_over_many_columns(spark):
    df = spark.range(500).select(*[(F.col("id") % (k + 1)).alias(f"c.{k}") for k in range(150)])
    assert S.distinct_counts(df, df.columns) == {f"c.{k}": k + 1 for k in range(150)}


def test_approximate_distinct_counts(spark):
    profile = Profile(spark.range(1000).selectExpr("cast(id as string) as s"), approx=True)
    assert abs(profile.distinct(["s"])["s"] - 1000) < 150
