"""Shared-pass fits of a search against plain numpy and Spark's single fits."""

import numpy as np
import pytest

from tablewright.operators import linear_pass as P
from tablewright.operators import search as H
from tablewright.operators.models import make_estimator


def planted(spark, classes, n=240, nulls=True):
    rng = np.random.default_rng(classes)
    a, b, c = rng.normal(size=n), rng.normal(5, 3, n), rng.integers(0, 4, n).astype(float)
    y = np.digitize(a + 0.3 * b - 1.5 + 0.8 * rng.normal(size=n), np.linspace(-1, 1, classes - 1)) if classes else 2 * a - b + rng.normal(size=n) + 1e5
    rows = [(i, None if nulls and i % 17 == 3 else float(a[i]), float(b[i]), float(c[i]), f"k{y[i]}" if classes else float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, f"id long, a double, b double, c double, y {'string' if classes else 'double'}")


def plain_folds(search, chosen):
    frame = search.table.toPandas().sort_values("id")
    for p in range(search.k + search.scoring.whole):
        train, held = (frame[frame.fold != p], frame[frame.fold == p]) if p < search.k else (frame, frame)
        fill = train[chosen].median()
        x, z = (t[chosen].fillna(fill) for t in (train, held))
        yield (x - x.mean()) / x.std(ddof=0), train.label, (z - x.mean()) / x.std(ddof=0), held.label


def test_least_squares_of_every_mask(spark):
    search = H.Search(planted(spark, 0), "y", "id", "regression")
    for mask in ([1, 0, 0], [0, 1, 1], [1, 1, 1]):
        chosen = [c for c, bit in zip("abc", mask) if bit]
        want = []
        for x, y, z, held in plain_folds(search, chosen):
            w = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
            want.append(1 - ((held - w[0] - z @ w[1:]) ** 2).sum() / ((held - held.mean()) ** 2).sum())
        assert np.allclose(search._least_squares(chosen), want, atol=1e-8)
    search.close()


def test_least_squares_of_repeated_and_constant_columns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=50)
    z = np.column_stack([np.ones(50), x, x, np.zeros(50), 3 * x + 1])
    gram = z.T @ z
    assert abs(P.least_squares_r2(gram, gram, [0, 1, 2]) - 1) < 1e-9
    flat = np.column_stack([np.ones(9), np.arange(9.0), np.full(9, 0.0)])
    assert P.least_squares_r2(flat.T @ flat, flat.T @ flat, [0]) == 1.0
    assert P.least_squares_r2(gram, gram * 0, [0]) is None


@pytest.mark.parametrize("classes", [2, 3])
def test_logistic_candidates_equal_single_fits(spark, classes):
    search = H.Search(planted(spark, classes), "y", "id", "classification")
    population = [H.Candidate("LogisticRegression", {"C": c, "max_iter": 1000}, mask) for c, mask in ((0.05, [1, 1, 0]), (8.0, [1, 1, 1]), (1.0, [0, 0, 1]), (1.0, [1, 1, 1]))]
    search.score_all(population)
    for candidate in population:
        chosen, right = search._chosen(candidate), []
        for (train, held), prep, size in zip(search.parts, search.preps, search.sizes):
            model = make_estimator("LogisticRegression", "classification", {**candidate.hparams, "tol": 1e-9}, size, classes).fit(search._vectors(train, prep, chosen))
            got = model.transform(search._vectors(held, prep, chosen)).select("label", "prediction").toPandas()
            right.append((got.label == got.prediction).mean())
        assert abs(candidate.scores["mu"] - np.mean(right[:5])) <= 2.5 / 240
        assert candidate.scores["sigma"] == pytest.approx(np.std(right[:5]), abs=0.01)
    search.close()


def test_logistic_optimum(spark):
    """At the end the penalised gradient is zero, computed plainly."""
    search = H.Search(planted(spark, 3), "y", "id", "classification")
    ends, take = [], P._Newton.take
    P._Newton.take = lambda self, *a: (take(self, *a), ends.append(self))
    try:
        search.evaluate(H.Candidate("LogisticRegression", {"C": 2.0}, [1, 1, 1]))
    finally:
        P._Newton.take = take
    models = {m.part: m for m in ends}
    assert len(models) == 6 and all(m.done for m in models.values())
    for part, (x, y, _, _) in enumerate(plain_folds(search, ["a", "b", "c"])):
        w = models[part].point
        logits = np.column_stack([np.ones(len(x)), x]) @ w.T
        chances = np.exp(logits - logits.max(axis=1, keepdims=True))
        chances /= chances.sum(axis=1, keepdims=True)
        error = chances - (y.to_numpy()[:, None] == np.arange(3))
        slope = error.T @ np.column_stack([np.ones(len(x)), x]) / len(x)
        slope[:, 1:] += w[:, 1:] / (2.0 * len(x))
        assert np.abs(slope).max() < 1e-6
    search.close()


def test_older_scoring(spark):
    table = planted(spark, 0)
    search = H.Search(table, "y", "id", "regression", scoring=H.Scoring.v0())
    got = search.evaluate(H.Candidate("LinearRegression", {}, [1, 1, 0]))
    (x, y, z, held), = plain_folds(search, ["a", "b"])
    w = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
    r2 = 1 - ((held - w[0] - z @ w[1:]) ** 2).sum() / ((held - held.mean()) ** 2).sum()
    assert len(held) == 48 and got["fitness"] == pytest.approx(r2 + 0.1 / 3, abs=1e-9) and got["sigma"] is None
    failing = H.Candidate("GradientBoosting", {"max_depth": 99}, [1, 1, 1])
    with pytest.warns(UserWarning):
        search.score_all([failing])
    assert failing.fitness == 0.0
    forest = search.evaluate(H.Candidate("RandomForest", {"n_estimators": 10, "max_depth": 5}, [1, 1, 1]))
    assert 0.3 < forest["fitness"] <= 1
    search.close()
