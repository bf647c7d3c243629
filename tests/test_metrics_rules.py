import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from tablewright.operators import charts as J
from tablewright.operators import metrics as M
from tablewright.operators import rules as R
from tablewright.operators import search as H


def pairs(spark, truth, pred, kind="int"):
    return spark.createDataFrame(list(zip(truth, pred)), f"label {kind}, pred {kind}")


def test_perfect_and_imperfect_classes(spark):
    truth = [0, 0, 1, 1, 1, 0, 1, 0]
    assert tuple(M.classification_metrics(pairs(spark, truth, truth)).first()) == (1.0, 1.0, 1.0, 1.0)
    got = M.classification_metrics(pairs(spark, truth, [0, 1, 1, 1, 0, 1, 1, 0])).first()
    assert tuple(got) == (0.625, 0.619, 0.6333, 0.625)


def test_labels_only_predicted_or_only_true_count(spark):
    got = M.classification_metrics(pairs(spark, ["a", "a", "b"], ["a", "c", "c"], "string")).first()
    assert got["accuracy"] == 0.3333 and got["precision_macro"] == 0.3333 and got["recall_macro"] == 0.1667


def test_regression_vectors(spark):
    truth = [2.0, 4.0, 6.0, 9.0]
    assert tuple(M.regression_metrics(pairs(spark, truth, truth, "double")).first()) == (0.0, 0.0, 0.0, 1.0)
    got = M.regression_metrics(pairs(spark, truth, [3.0, 4.0, 5.0, 9.0], "double")).first()
    assert tuple(got) == (0.5, 0.7071, 0.5, 0.9252)


def test_regression_edges(spark):
    assert M.regression_metrics(pairs(spark, [1.0], [1.0], "double")).first()["r2"] is None
    assert M.regression_metrics(pairs(spark, [2.0, 2.0], [2.0, 2.0], "double")).first()["r2"] == 1.0
    assert M.regression_metrics(pairs(spark, [2.0, 2.0], [2.0, 3.0], "double")).first()["r2"] == 0.0
    # The root is taken of the rounded mean.
    assert M.regression_metrics(pairs(spark, [0.0, 0.0], [0.01, 0.0], "double")).first()["rmse"] == 0.01


def test_gap_directions(spark):
    table = spark.createDataFrame([("m", "train", 0.9, 1.0), ("m", "test", 0.7, 3.5)], "model string, split string, accuracy double, rmse double")
    assert M.overfitting_gap(table, "classification").first()["overfitting_gap"] == 0.2
    assert M.overfitting_gap(table, "regression").first()["overfitting_gap"] == 2.5


def test_fitness_by_hand(spark):
    df = spark.createDataFrame([
        (1, "RandomForest", 100, None, 5, 10, 0.9, 0.1, 0.05), (2, "DecisionTree", 100, 1, 10, 10, 0.9, 0.0, 0.0),
        (3, "KNN", 100, 10, 1, 10, None, None, None)],
        "cand_id int, model string, n_estimators int, max_depth int, n_selected int, n_features int, mu double, sigma double, gap double")
    got = {r["cand_id"]: r for r in H.fitness(df, 0.5).collect()}
    assert abs(got[1]["complexity"] - (0.4 * 0.5 + 0.6 * (0.2 + 0.5))) < 1e-12
    assert abs(got[2]["complexity"] - (0.4 + 0.6 * 0.1)) < 1e-12
    scale = 1.75
    want = 0.9 - 0.05 * scale * got[1]["complexity"] - 0.15 * scale * 0.1 - 0.1 * scale * 0.05
    assert abs(got[1]["fitness"] - want) < 1e-12 and got[3]["fitness"] == -1.0


def test_best_candidate_ties_and_failures(spark):
    df = spark.createDataFrame([(3, "b", 0.5), (1, "a", 0.5), (2, "c", None)], "cand_id int, model string, fitness double")
    assert tuple(H.best_candidate(df).first()) == (1, "a", 0.5)


def test_plateau_from_the_fourth_generation(spark):
    rows = [(1, g, 0.5) for g in range(1, 6)]
    got = H.plateaus(spark.createDataFrame(rows, "run int, gen int, best_fitness double"), "run")
    assert [r["plateau"] for r in got.orderBy("gen").collect()] == [False, False, False, True, True]


@pytest.mark.parametrize("reply,required,defaults,strict,status,missing,fields", [
    ('{"path": "supervised", "target": "y"}', [], {}, False, "ok", [], {"path": "supervised", "target": "y"}),
    ('```json\n{"key": "value"}\n```', [], {}, False, "ok", [], {"key": "value"}),
    ('  ```\n{"key":\n "v"}\n  ```  ', [], {}, False, "ok", [], {"key": "v"}),
    ('{"a": 1}', ["b"], {}, True, "missing_required", ["b"], None),
    ('{"a": 1}', ["b"], {}, False, "ok", ["b"], {"a": "1"}),
    ('{"a": 1}', [], {"b": 2, "c": 42}, False, "ok", [], {"a": "1", "b": "2", "c": "42"}),
    ('{"a": 1}', [], {"a": 9, "n": None, "l": ["x"]}, False, "ok", [], {"a": "1", "n": None, "l": '["x"]'}),
    ("no object here", [], {}, False, "invalid_json", None, None),
    ("[4, 5]", [], {}, False, "not_object", None, None),
    ('{"k": 1} and more', ["k"], {}, False, "invalid_json", None, None),
    ('{"k": 1}{"x": 1}', ["k"], {}, False, "invalid_json", None, None),
    ('{"k": 1}] [{"x": 1}', ["k"], {}, False, "invalid_json", None, None),
    ('{"k": 1, "k": 2, "a": 3}', ["k"], {}, False, "ok", [], {"k": "2", "a": "3"}),
    ("", [], {}, False, "invalid_json", None, None),
    (None, [], {}, False, "invalid_json", None, None),
])
def test_reply_validation(spark, reply, required, defaults, strict, status, missing, fields):
    df = spark.createDataFrame([(reply,)], "reply string")
    got = R.validate_replies(df, "reply", required, defaults, strict).first()
    assert (got["status"], got["missing"], got["fields"]) == (status, missing, fields)


def test_reply_kinds_fill_their_defaults(spark):
    df = spark.createDataFrame([("{}",)], "reply string")
    for required, defaults in R.REPLY_KINDS.values():
        got = R.validate_replies(df, "reply", required, defaults).first()
        assert got["missing"] == required and set(got["fields"]) == set(defaults)


def test_review_rules(spark):
    runs = spark.createDataFrame([(1, 0.95, 0.90), (2, 0.99, 0.80), (3, 0.80, 0.80), (4, 1.0, 0.999), (5, 0.9, 0.9)],
                                 "run_id int, train_score double, test_score double")
    imp = spark.createDataFrame([(5, "num__a", 0.6), (5, "num__b", 0.4)], "run_id int, feature string, importance double")
    got = {r["run_id"]: r for r in R.review(runs, imp, F.lit(1)).collect()}
    assert got[1]["status"] == "satisfied" and got[1]["issues"] is None
    assert got[2]["issues"] == "OVERFITTING DETECTED (Train 0.990 vs Test 0.800)."
    assert got[3]["issues"] == "UNDERPERFORMING (Test score 0.800 < 0.85 Target)."
    assert got[4]["issues"].startswith("DATA LEAKAGE DETECTED (Test score 0.999 >= 0.999")
    assert got[5]["issues"] == "FEATURE DOMINANCE DETECTED ('num__a' contributes 0.600!)."
    assert {r["status"] for r in R.review(runs, imp, F.lit(3)).collect()} == {"satisfied"}
    assert R.best_run(runs).first()["run_id"] == 4


def test_triage(spark):
    df = spark.createDataFrame([(0.2, 200, 30), (0.4, 200, 30), (0.6, 10, 3), (0.9, 10, 3), (None, 50, 30)],
                               "confidence double, num_rows long, num_columns long")
    got = [(r["path"], r["path_v0"], r["confidence_level"]) for r in R.triage(df).collect()]
    assert got == [("unsupervised", "unsupervised", "Medium"), ("supervised", "unsupervised", "Medium"),
                   ("supervised", "supervised", "Medium"), ("supervised", "supervised", "High"),
                   ("unsupervised", "supervised", "Medium")]


def test_trace(spark):
    steps = spark.createDataFrame([("a", 1.0, 1.25, "success", "x" * 600, "o"), ("a", 1.0, 0.0, "running", "i", "o"),
                                   ("b", 2.0, 2.5, "error", "i", "o"), ("b", 0.0, 0.0, "pending", "i", "o")],
                                  "agent_name string, started_at double, finished_at double, status string, "
                                  "input_summary string, output_summary string")
    full = R.trace_steps(steps)
    assert full.agg(F.max(F.length("input_summary"))).first()[0] == 500
    got = {r["agent_name"]: r for r in R.trace_rollup(full).collect()}
    assert (got["a"]["total_duration_ms"], got["a"]["n_running"], got["b"]["total_duration_ms"]) == (250.0, 1, 500.0)


def test_leaderboard_text(spark):
    df = spark.createDataFrame([("d", 0.2825, 0.78175, 0.7465, 0.0029, "RandomForest")],
                               "dataset string, ori double, mu double, fitness double, gap double, model string")
    row = R.leaderboard(df).first()
    assert (row["ori"], row["best_mu_cv"]) == (f"{0.2825:.3f}", f"{0.78175:.4f}")


def test_histogram_edges(spark):
    assert J.histogram(spark.createDataFrame([], "x double"), "x").count() == 0
    flat = J.histogram(spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double"), "x").orderBy("bin").collect()
    assert [r["n"] for r in flat] == [2] + [0] * 19
    top = J.histogram(spark.range(21).toDF("x"), "x").orderBy("bin").collect()
    assert [r["n"] for r in top] == [1] * 19 + [2]


def test_density_and_box(spark):
    df = spark.createDataFrame([(float(i), float(i % 4)) for i in range(40)] + [(1000.0, 1.0), (None, 2.0)], "x double, y double")
    assert J.scatter_density(df, "x", "y").agg(F.sum("n")).first()[0] == 41
    box = {r["column"]: r for r in J.box_summary(df).collect()}
    assert box["x"]["outliers"] == 1 and box["x"]["whisker_high"] == 39.0 and box["x"]["max"] == 1000.0


def test_preview_cuts_cells(spark):
    df = spark.range(30).selectExpr("id", "repeat('z', 40) as s")
    got = rows_of(R.preview(df, ["id"]))
    assert len(got) == 15 and {len(r[1]) for r in got} == {15}
