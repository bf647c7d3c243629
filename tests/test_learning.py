import json

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from conftest import rows_of
from tablewright.functions.session import shared_path
from tablewright.operators import models as G
from tablewright.operators import search as H
from tablewright.operators.knn import knn_join, knn_predict
from tablewright.operators.profile import Profile
from tablewright.operators.svm import FourierFeatures, fit_svr, svr_objective
from tablewright.sources.sinks import save_model


@pytest.fixture(scope="module")
def signal(spark):
    """A class and a number that follow from two of three features; one null and one odd category."""
    draw = np.random.default_rng(1)
    x = draw.normal(size=(240, 3))
    rows = [(i, float(a), float(b), float(c), "uv"[i % 2], bool(i % 2), float(3 * a + 2 * b + 0.1 * c),
             "hi" if a + b > 0.4 else "mid" if a + b > -0.6 else "lo") for i, (a, b, c) in enumerate(x)]
    rows[7] = rows[7][:1] + (None,) + rows[7][2:]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, seg string, flag boolean, y double, cls string").persist()


def test_router_and_names(signal):
    df = signal.drop("y")
    numeric, categorical = G.routed_columns(Profile(df, "cls"))
    assert numeric == ["id", "a", "b", "c"] and categorical == ["seg"]
    prep = G.fit_prep(df, ["a", "b"], ["seg"])
    assert G.feature_names(prep) == ["num__a", "num__b", "cat__seg_u", "cat__seg_v"]
    odd = df.where("id = 0").withColumns({"seg": F.lit("never seen"), "a": F.lit(float("inf"))})
    vector = prep.transform(odd).first()["features"].toArray()
    assert vector[2:].tolist() == [0.0, 0.0] and np.isfinite(vector).all()


def test_dotted_column_names(spark):
    df = spark.createDataFrame([(i, float(i), "ab"[i % 2], 2.0 * i) for i in range(20)],
                               "id long, `x.y` double, `s.t` string, target double")
    fitted = G.fit_model(df, "target", "regression", "LinearRegression", numeric=["x.y"], categorical=["s.t"])
    assert G.feature_names(fitted.prep) == ["num__x.y", "cat__s.t_a", "cat__s.t_b"]
    assert abs(fitted.transform(df).where("id = 7").first()["prediction"] - 14.0) < 1e-6


def test_linear_regression_matches_least_squares(signal):
    fitted = G.fit_model(signal, "y", "regression", "LinearRegression", numeric=["a", "b", "c"])
    rows = [r["features"].toArray() for r in fitted.prep.transform(signal).orderBy("id").collect()]
    x = np.column_stack([np.array(rows), np.ones(len(rows))])
    y = np.array([r["y"] for r in signal.orderBy("id").collect()])
    want = np.linalg.lstsq(x, y, rcond=None)[0]
    got = np.append(fitted.predictor.coefficients.toArray(), fitted.predictor.intercept)
    assert np.allclose(got, want, atol=1e-8)


def test_logistic_regression_matches_newton(signal):
    df = signal.where("cls <> 'mid'")
    fitted = G.fit_model(df, "cls", "classification", "LogisticRegression", {"C": 0.5}, ["a", "b"])
    table = fitted.prep.transform(df).select("features", "cls").collect()
    x = np.column_stack([[r["features"].toArray() for r in table], np.ones(len(table))])
    y = np.array([r["cls"] == "lo" for r in table], dtype=float)
    w, ridge = np.zeros(3), np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = 0.5 * x.T @ (p - y) + ridge @ w
        w -= np.linalg.solve(0.5 * (x.T * (p * (1 - p))) @ x + ridge, gradient)
    got = np.append(fitted.predictor.coefficients.toArray(), fitted.predictor.intercept)
    assert np.allclose(got, w, rtol=1e-3, atol=1e-3)


@pytest.mark.parametrize("model,hparams,target", [
    ("RandomForest", {"n_estimators": 10, "max_depth": 4, "max_features": 0.7}, "cls"),
    ("DecisionTree", {"max_depth": 4}, "y"), ("KNN", {"n_neighbors": 5}, "cls"), ("KNN", {"n_neighbors": 5}, "y"),
    ("GradientBoosting", {"n_estimators": 5, "max_depth": 3}, "cls"),
    ("GradientBoosting", {"n_estimators": 5, "max_depth": 3}, "y"),
    ("SVM", {"C": 1.0, "kernel": "poly"}, "y"), ("SVM", {"C": 1.0, "kernel": "rbf"}, "cls")])
def test_models_learn(signal, model, hparams, target):
    df = signal.select("id", "a", "b", "c", "seg", target)
    _, table = G.train_final(df, target, "id", model, hparams)
    scores = {r["split"]: r["accuracy" if target == "cls" else "r2"] for r in table.collect()}
    assert scores["test"] > (0.6 if target == "cls" else 0.5)


def test_importances_sum_to_one(signal):
    fitted, _ = G.train_final(signal.drop("cls"), "y", "id", "RandomForest", {"n_estimators": 10, "max_depth": 4})
    table = fitted.importances()
    assert abs(table.agg(F.sum("importance")).first()[0] - 1) < 1e-3
    assert G.top_importances(table, 2).first()["feature"] == "num__a"
    linear = G.fit_model(signal, "y", "regression", "LinearRegression", numeric=["a"])
    assert linear.importances().count() == 0


@pytest.mark.parametrize("model,hparams,target", [
    ("SVM", {"kernel": "rbf"}, "cls"), ("SVM", {"kernel": "poly"}, "y")])
def test_saved_model_predicts_the_same(spark, signal, model, hparams, target):
    problem = "classification" if target == "cls" else "regression"
    fitted = G.fit_model(signal, target, problem, model, hparams, ["a", "b"], ["seg"])
    path = save_model(fitted, shared_path(spark, "model"))
    assert path.endswith(f"{model.lower()}_best")
    again = G.FittedModel.load(path)
    assert rows_of(fitted.transform(signal).select("id", "prediction"), "id") == \
        rows_of(again.transform(signal).select("id", "prediction"), "id")


@pytest.mark.parametrize("target", ["cls", "pair"])
def test_svc_without_stored_features(spark, signal, monkeypatch, target):
    """Tables whose kernel features are too many to keep: the same objective as Spark's learner, no expanded column."""
    df = signal.withColumn("pair", F.when(F.col("cls") == "lo", "lo").otherwise("other"))
    hparams = {"C": 1.0, "kernel": "rbf"}
    kept = G.fit_model(df, target, "classification", "SVM", hparams, ["a", "b"])
    monkeypatch.setattr(G, "KEPT_CELLS", 0)
    monkeypatch.setattr(FourierFeatures, "transform", None)
    monkeypatch.setattr(G, "make_estimator", None)
    anew = G.fit_model(df, target, "classification", "SVM", hparams, ["a", "b"])
    weights = anew.predictor.weights
    assert len(weights) == (3 if target == "cls" else 1) == len(getattr(kept.predictor, "models", [0]))
    rows = anew.prep.transform(df).select("features", target).collect()
    z = anew.predictor.expand.drawn()(np.array([r["features"].toArray() for r in rows]))
    label = np.array([anew.labels.index(r[target]) for r in rows])

    def objective(w, b, k):
        sign = np.where(label == (k if target == "cls" else 1), 1.0, -1.0)
        return np.maximum(0, 1 - sign * (z @ w + b)).mean() + w @ w / (2 * len(rows))
    for k, w in enumerate(weights):
        one = kept.predictor.models[k] if target == "cls" else kept.predictor
        assert objective(w[1:], w[0], k) <= 1.01 * objective(one.coefficients.toArray(), one.intercept, k)
    again = G.FittedModel.load(save_model(anew, shared_path(spark, "model")))
    made = [rows_of(m.transform(df).select("id", "prediction"), "id") for m in (anew, again)]
    assert made[0] == made[1] and {p for _, p in made[0]} <= set(anew.labels)


def test_svr_beats_least_squares_under_gross_errors(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=300)
    y = 2 * x + 1 + draw.normal(0, 0.05, 300)
    y[:30] += 40
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(Vectors.dense(float(a)), float(b)) for a, b in zip(x, y)], ["features", "label"])
    model = fit_svr(df, c=1.0)

    def objective(w, b):
        return 0.5 * w * w + np.maximum(np.abs(y - w * x - b) - 0.1, 0).sum()
    got = svr_objective(model, df)
    grid = min(objective(w, b) for w in np.linspace(1.8, 2.2, 81) for b in np.linspace(0.8, 1.4, 121))
    assert abs(got - objective(model.coefficients[0], model.intercept)) < 1e-6
    assert got <= grid * 1.002


def test_fourier_features_approximate_the_kernel(spark):
    from pyspark.ml.linalg import Vectors
    points = np.random.default_rng(4).normal(size=(6, 2))
    df = spark.createDataFrame([(Vectors.dense(p),) for p in points.tolist()], ["features"])
    z = np.array([r["expanded"].toArray() for r in FourierFeatures(2, 0.5, size=4096).transform(df).collect()])
    want = np.exp(-0.5 * ((points[:, None] - points[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - want).max() < 0.08


def brute(queries, train, k):
    out = {}
    for q, v in queries:
        ranked = sorted((round(float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), 9), t) for t, w in train)
        out[q] = [t for _, t in ranked[:k]]
    return out


@pytest.mark.parametrize("pivots,block", [(1, 1000), (6, 20)])
def test_knn_equals_brute_force_with_hot_copies(spark, pivots, block):
    draw = np.random.default_rng(6)
    train = [(i, [1.0, 1.0, 1.0] if i % 3 == 0 else draw.integers(-3, 4, 3).astype(float).tolist()) for i in range(120)]
    queries = [(1000 + i, [1.0, 1.0, 1.0] if i % 4 == 0 else draw.normal(0, 2, 3).tolist()) for i in range(40)]
    a = spark.createDataFrame(queries, "q long, v array<double>")
    b = spark.createDataFrame(train, "t long, v array<double>")
    got = knn_join(a, b, "q", "t", "v", 4, pivots, block)
    found = {}
    for r in got.orderBy("q", "place").collect():
        found.setdefault(r["q"], []).append(r["neighbour"])
    assert found == brute(queries, train, 4)


def test_knn_with_few_training_rows_and_ties(spark):
    train = spark.createDataFrame([(1, [0.0], "b"), (2, [2.0], "a")], "t long, v array<double>, label string")
    queries = spark.createDataFrame([(9, [1.0])], "t long, v array<double>")
    assert knn_join(queries, train, "t", "t", "v", 5).count() == 2
    assert rows_of(knn_predict(queries, train, "t", "t", "v", "label", "classification", 5)) == [(9, "a")]


def test_proposals_are_seeded_and_valid():
    first = [H.Proposer("classification", 10, None, H.Settings(), 5).fresh() for _ in range(2)]
    assert first[0].identity() == first[1].identity()
    proposer = H.Proposer("regression", 5, "RandomForest", H.Settings(), 1)
    population = [proposer.fresh() for _ in range(10)]
    for c in population:
        c.scores = {"fitness": sum(c.mask) / 10}
    ranked = sorted(population, key=lambda c: -c.fitness)
    after = proposer.next_generation(ranked)
    assert len(after) == 10 and after[0] is ranked[0]
    assert all(len(c.mask) == 5 and sum(c.mask) >= 1 and c.hparams["n_estimators"] >= 10 for c in after)
    assert H.Settings.v0().elite_count(10) == 2 and H.Settings.v0().contestants(10) == 3
    assert H.Settings().contestants(5) == 2


def test_search_scores_match_a_plain_refit(spark, signal):
    search = H.Search(signal.drop("cls", "seg"), "y", "id", "regression")
    assert search.usable == ["a", "b", "c", "flag"]
    got = search.evaluate(H.Candidate("LinearRegression", {}, [1, 1, 0, 0]))
    frame = search.table.select("a", "b", "label", "fold").toPandas()
    scores = []
    for f in range(5):
        train, test = frame[frame.fold != f], frame[frame.fold == f]
        fill = train[["a", "b"]].median()
        x = lambda t: np.column_stack([t[["a", "b"]].fillna(fill), np.ones(len(t))])
        w = np.linalg.lstsq(x(train), train.label, rcond=None)[0]
        error = test.label - x(test) @ w
        scores.append(1 - (error ** 2).sum() / ((test.label - test.label.mean()) ** 2).sum())
    assert abs(got["mu"] - np.mean(scores)) < 1e-9 and abs(got["sigma"] - np.std(scores)) < 1e-9
    assert search.evaluate(H.Candidate("LinearRegression", {}, [0, 0, 0, 0])) is None
    history, candidates = H.evolve(search, 3, 3, "LinearRegression", patience=1)
    best = [r["best_fitness"] for r in history.orderBy("gen").collect()]
    assert best == sorted(best) and 2 <= len(best) <= 3
    assert candidates.where("fitness is null").count() == 0
    search.close()


def test_failed_candidates_score_minus_one(signal):
    search = H.Search(signal.drop("cls", "seg"), "y", "id", "regression")
    broken = H.Candidate("GradientBoosting", {"n_estimators": 5, "max_depth": 99}, [1, 1, 1, 1])
    with pytest.warns(UserWarning):
        search.score_all([broken])
    assert broken.fitness == -1.0
    search.close()


def test_whole_supervised_run(signal):
    from tablewright.plans.pipeline import supervised_run
    out = supervised_run(signal.drop("y"), "cls", "id", proposals=[{"name": "ab", "expr": "a + b"}, {"name": "z", "expr": "zz"}],
                         drops=["num__c"], model="DecisionTree", size=2, generations=1)
    assert [r["applied"] for r in out["derived"].collect()] == [True, False]
    assert out["dropped"].first()["dropped"] and "c" not in out["table"].columns
    assert out["metrics"].count() == 2 and out["review"].count() == 1
    assert json.loads(out["candidates"].first()["hparams"])


@pytest.mark.parametrize("scale", [0.01, 1.0, 1000.0])
def test_svr_reaches_the_optimum_at_any_label_scale(spark, scale):
    draw = np.random.default_rng(12)
    x = draw.uniform(0, 3, 60)
    y = scale * (1.5 * x - 2 + 0.4 * draw.normal(size=60))
    df = spark.createDataFrame([(Vectors.dense([float(a)]), float(b)) for a, b in zip(x, y)], ["features", "label"])

    def least(f, low, high):
        for _ in range(80):
            a, b = low + (high - low) / 3, high - (high - low) / 3
            low, high = (low, b) if f(a) < f(b) else (a, high)
        return f((low + high) / 2)

    def objective(w, b):
        return 0.5 * w * w + np.maximum(np.abs(y - w * x - b) - 0.1, 0).sum()

    best = least(lambda w: least(lambda b: objective(w, b), -10 * scale, 10 * scale), -4 * scale, 4 * scale)
    assert svr_objective(fit_svr(df, c=1.0), df) <= best * 1.005 + 1e-9
