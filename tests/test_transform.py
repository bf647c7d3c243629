import pandas as pd
import pytest

from conftest import rows_of
from tablewright.functions.columns import scrub_nonfinite
from tablewright.operators import features as X
from tablewright.operators import prep as P
from tablewright.operators.outliers import fit_treatment, treat_outliers


@pytest.fixture(scope="module")
def spiked(spark):
    rows = [(i, float(i % 5)) for i in range(60)] + [(60, 500.0), (61, None), (62, float("nan"))]
    return spark.createDataFrame(rows, "id long, x double")


def test_scrub(mixed):
    got = [r[0] for r in rows_of(scrub_nonfinite(mixed).orderBy("id").select("`a.b`"))]
    assert got == [1.0, 2.0, None, 4.0, None, 6.0, None, 8.0, None, 100.0]


def test_remove_keeps_missing_rows(spiked):
    kept = [r[0] for r in rows_of(treat_outliers(spiked, "remove", key="id").select("id"), "id")]
    assert kept == list(range(60)) + [61, 62]


def test_cap_clips_to_fences(spiked):
    frame = pd.Series([float(i % 5) for i in range(60)] + [500.0])
    q1, q3 = frame.quantile(0.25), frame.quantile(0.75)
    got = dict(rows_of(treat_outliers(spiked, "cap", key="id").select("id", "x")))
    assert got[60] == q3 + 1.5 * (q3 - q1) and got[61] is None and got[62] is None and got[3] == 3.0


def test_log_needs_whole_nonnegative_column(spark, spiked):
    assert dict(rows_of(treat_outliers(spiked, "log", key="id").select("id", "x")))[60] == 500.0
    whole = spiked.where("x is not null and not isnan(x)")
    assert abs(dict(rows_of(treat_outliers(whole, "log", key="id").select("id", "x")))[60] - 6.2166061) < 1e-6


def test_flag_and_keep(spiked):
    flagged = dict(rows_of(treat_outliers(spiked, "flag", key="id").select("id", "is_outlier_x")))
    assert flagged[60] == 1 and flagged[61] == 0 and sum(flagged.values()) == 1
    assert treat_outliers(spiked, "keep", key="id").count() == 63


def test_nothing_flagged_is_kept(spark):
    fitted = fit_treatment(spark.range(10).selectExpr("id", "cast(id as double) as x"), "remove", key="id")
    assert (fitted.strategy, fitted.columns, fitted.total) == ("keep", [], 0)
    with pytest.raises(ValueError):
        fit_treatment(spark.range(3).toDF("x"), "shuffle")


def test_derivation_rules(spark):
    df = spark.createDataFrame([(1.0, 0.0), (4.0, 2.0), (-9.0, None)], "a double, b double")
    got, report = X.derive(df, [
        {"name": "r", "expr": "a / b"}, {"name": "l", "expr": "ln(a)"}, {"name": "r2", "expr": "r + 1"},
        {"name": "s", "expr": "sqrt(a)"}, {"name": "bad", "expr": "missing + 1"}, {"name": "", "expr": ""},
        {"name": "m", "expr": "max(a)"}, {"name": "j", "expr": "java_method('java.lang.Math', 'abs', 1)"},
        {"name": "text", "expr": "concat('select max(', cast(a as string), ')')"}])
    assert rows_of(got.select("a", "r", "r2", "s"), "a") == [(-9.0, None, None, None), (1.0, None, None, 1.0),
                                                            (4.0, 2.0, 3.0, 2.0)]
    applied = {r["name"]: r["applied"] for r in report.collect()}
    assert applied == {"r": True, "l": True, "r2": True, "s": True, "bad": False, "": False, "m": False,
                       "j": False, "text": True}
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


@pytest.mark.parametrize("expression", [
    "explode(array(1, 2))", "sum(a)", "sum(a) over ()", "(select 1)", "rand()", "uuid()", "a -> 1",
    "reflect('java.lang.Runtime', 'exit')", "a; drop table t", "a -- b", "monotonically_increasing_id()"])
def test_guard_rejects(expression):
    assert X.expression_problem(expression)


@pytest.mark.parametrize("expression", [
    "a + b * 2", "case when a > 1 and (b < 2) then 1 else 0 end", "log1p(abs(a))", "a in (1, 2)",
    "coalesce(a, 0)", "concat(`over it`, ' from ')"])
def test_guard_accepts(expression):
    assert X.expression_problem(expression) is None


def test_drop_features(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, `b c` int, y int")
    kept, report = X.drop_features(df, ["num__a", " 'b c' ", "y", "zz"], "y")
    assert kept.columns == ["y"]
    assert rows_of(report) == [("num__a", "a", True), (" 'b c' ", "b c", True), ("y", "y", False), ("zz", "zz", False)]


def test_fill_nulls(mixed):
    got = X.fill_nulls(mixed, {"a.b": "median", "naïve": "mode", "empty": "mean"})
    first = got.where("id = 3").first()
    assert first["a.b"] == 5.0 and got.where("id = 4").first()["naïve"] == "b"  # three of "b", "ä": smallest
    assert got.where("empty is not null").count() == 0
    assert X.fill_nulls(mixed, {"a.b": "drop"}).count() == 6


def test_mode_ties_and_medians(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("b", 3.0), ("a", 4.0), (None, float("nan"))], "s string, x double")
    assert P.column_modes(df, ["s"]) == {"s": "a"}
    assert [r[1] for r in rows_of(P.impute_median(df, ["x"]), "x")] == [1.0, 2.0, 2.5, 3.0, 4.0]


def test_scaling_is_fitted_on_the_filled_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, None), (9.0, 5.0)], "x double, c double")
    filled = pd.Series([1.0, 2.0, 2.0, 9.0])
    want = ((filled - filled.mean()) / filled.std(ddof=0)).sort_values().round(9).tolist()
    got = P.standardise(df, ["x", "c"])
    assert sorted(round(r["num__x"], 9) for r in got.collect()) == want
    assert {r["num__c"] for r in got.collect()} == {0.0}


def test_one_hot_unseen_and_limit(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    got = P.one_hot(df, ["s"], fit_on=df.where("s = 'a'"))
    assert rows_of(got, "s") == [(None, 0), ("a", 1), ("b", 0)]
    with pytest.raises(ValueError):
        P.categories(spark.range(5).selectExpr("cast(id as string) as s"), "s", limit=3)


def test_split_sizes_and_layout(spark):
    df = spark.range(1003).selectExpr("id", "case when id % 10 = 0 then 'rare' when id % 7 = 0 then null else 'hot' end as y")
    one = rows_of(P.split(df.repartition(1), ["id"], "y").select("id", "split"), "id")
    assert one == rows_of(P.split(df.repartition(7), ["id"], "y").select("id", "split"), "id")
    sizes = {(r["y"], r["split"]): r["count"] for r in P.split(df, ["id"], "y").groupBy("y", "split").count().collect()}
    for y in ("rare", "hot", None):
        total = sizes[y, "test"] + sizes[y, "train"]
        assert sizes[y, "test"] == -(-total // 5)
    plain = {r["split"]: r["count"] for r in P.split(df, ["id"]).groupBy("split").count().collect()}
    assert plain == {"test": 201, "train": 802}


def test_fold_sizes(spark):
    df = spark.range(1003).selectExpr("id", "id % 3 as y")
    sizes = [r["count"] for r in P.folds(df, ["id"]).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [201, 201, 201, 200, 200]
    per = P.folds(df, ["id"], "y").groupBy("y", "fold").count().collect()
    assert len(per) == 15 and {r["count"] for r in per} <= {66, 67}


def test_tiny_classes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id long, y string")
    got = {r["id"]: r["split"] for r in P.split(df, ["id"], "y").collect()}
    assert got[1] == "test" and sorted([got[2], got[3]]) == ["test", "train"]
    assert P.folds(df, ["id"], "y").count() == 3
