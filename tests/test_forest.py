"""Trees and forests against a plain recursive version."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablewright.operators import forest as T


def score(labels, weights, classes):
    if classes:
        sums = np.array([weights[labels == c].sum() for c in range(classes)])
        return (sums ** 2).sum() / sums.sum()
    return (weights * labels).sum() ** 2 / weights.sum()


def plain_tree(x, labels, weights, rules, depth=0):
    """Best cut of every feature at every place, one node after the other."""
    pure = len(set(labels)) == 1
    total = score(labels, weights, rules.classes)
    best = None
    if not pure and len(x) >= rules.split_rows and (rules.depth is None or depth < rules.depth):
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for low, high in zip(values, values[1:]):
                left = x[:, f] <= low
                if min(left.sum(), (~left).sum()) < rules.leaf_rows:
                    continue
                got = score(labels[left], weights[left], rules.classes) + score(labels[~left], weights[~left], rules.classes)
                if best is None or got > best[0] + 1e-9 * abs(got):
                    best = (got, f, low + (high - low) / 2, left)
    if best is None:
        shares = [weights[labels == c].sum() / weights.sum() for c in range(rules.classes)] if rules.classes else [np.average(labels, weights=weights)]
        return lambda row: shares
    _, f, cut, left = best
    low, high = (plain_tree(x[m], labels[m], weights[m], rules, depth + 1) for m in (left, ~left))
    del total
    return lambda row: low(row) if row[f] <= cut else high(row)


def data(classes, n=150, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), np.round(rng.normal(size=n), 1), rng.normal(size=n), np.ones(n)]).astype(float)
    labels = rng.integers(0, classes, n).astype(float) if classes else np.round(x[:, 0] * 2 + rng.normal(size=n), 2) + 1000
    return x, labels, rng.integers(0, 3, n).astype(float)


@pytest.mark.parametrize("classes", [0, 2, 3])
@pytest.mark.parametrize("limits", [{}, {"depth": 3}, {"split_rows": 17}, {"leaf_rows": 6}, {"split_rows": 30, "leaf_rows": 4, "depth": 5}])
def test_exact_splits(classes, limits):
    rules = T.TreeRules(classes=classes, **limits)
    x, labels, weights = data(classes)
    tree = T.grow(x, labels, weights, rules, np.random.default_rng(0))
    used = weights > 0
    want = plain_tree(x[used], labels[used], weights[used], rules)
    got = tree["value"][T.leaves(tree, x)]
    assert np.allclose(got, [want(row) for row in x])
    if not limits:
        assert classes or np.allclose(got[used, 0], [labels[used][(x[used] == row).all(axis=1)].mean() for row in x[used]], atol=5)


@pytest.mark.parametrize("limits", [{}, {"depth": 3}, {"split_rows": 30, "leaf_rows": 4}])
@pytest.mark.parametrize("few", [0, 256])
def test_counted_features_give_the_same_trees(monkeypatch, limits, few):
    rules = T.TreeRules(**limits)
    x, labels, weights = data(0)
    x[:, 2] = np.round(x[:, 2], 3) + np.arange(len(x)) * 1e-6  # no equal scores but for copies of a cut
    want = T.grow(x, labels, weights, rules, np.random.default_rng(0))
    monkeypatch.setattr(T, "SORTED_ROWS", 0)
    monkeypatch.setattr(T, "FEW_VALUES", few)
    got = T.grow([T.Coded.of(c) for c in x.T], labels, weights, rules, np.random.default_rng(0))
    used = weights > 0
    assert np.allclose(got["value"][T.leaves(got, x[used])], want["value"][T.leaves(want, x[used])])


def test_odd_tables():
    rules = T.TreeRules(classes=2)
    one = T.grow(np.ones((1, 2)), np.array([1.0]), np.array([1.0]), rules, np.random.default_rng(0))
    assert one["feature"].tolist() == [-1] and one["value"].tolist() == [[0.0, 1.0]]
    same = T.grow(np.ones((5, 2)), np.array([0, 1, 1, 1, 0.0]), np.ones(5), rules, np.random.default_rng(0))
    assert same["value"].tolist() == [[0.4, 0.6]]
    deep = T.grow(np.arange(400.0)[:, None], np.arange(400.0) % 2, np.ones(400), rules, np.random.default_rng(0))
    assert (deep["value"].max(axis=1)[deep["feature"] < 0] == 1).all() and (deep["feature"] < 0).sum() == 400


def frame(spark, x, labels):
    rows = [(i, [float(v) for v in r], float(y)) for i, (r, y) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, "id long, x array<double>, label double").withColumn("features", array_to_vector("x"))


@pytest.mark.parametrize("classes", [0, 3])
def test_forest_of_one_task(spark, classes):
    x, labels, _ = data(classes)
    df = frame(spark, x, labels).repartition(3)
    rules = T.TreeRules(trees=7, classes=classes, columns="sqrt", drawn=True, leaf_rows=2)
    model = T.Forest(rules, "id").fit(df)
    rows = df.withColumn("hash", F.xxhash64("id")).collect()
    ids = np.array([r.hash for r in rows])
    order = np.argsort(ids)
    px, py, ids = np.array([r.x for r in rows])[order], np.array([r.label for r in rows])[order], ids[order]
    votes = np.zeros((len(px), classes or 1))
    for t in range(7):
        tree = T.grow(px, py, T.row_weights(ids, t, rules), rules, T._rng(rules, t))
        votes += tree["value"][T.leaves(tree, px)]
    want = votes.argmax(axis=1) if classes else votes[:, 0] / 7
    got = {r.id: r.prediction for r in model.transform(df).collect()}
    assert np.allclose([got[rows[i].id] for i in order], want)
    again = T.Forest(rules, "id").fit(df.repartition(5))
    assert {r.id: r.prediction for r in again.transform(df).collect()} == got
    shares = model.featureImportances.toArray()
    assert abs(shares.sum() - 1) < 1e-9 and shares[3] == 0 and (classes or shares[0] > 0.5)


def test_portions_and_saved_model(spark, monkeypatch, tmp_path):
    x, labels, _ = data(2)
    df = frame(spark, x, labels)
    model = T.Forest(T.TreeRules(trees=5, classes=2, drawn=True), "id").fit(df)
    whole = {r.id: r.prediction for r in model.transform(df).collect()}
    model.save(str(tmp_path / "m"))
    monkeypatch.setattr(T, "MODEL_BYTES", 1)
    assert len(model._pieces()) == 5
    assert {r.id: r.prediction for r in T.ForestModel.load(str(tmp_path / "m")).transform(df).collect()} == whole


@pytest.mark.parametrize("classes", [0, 2])
def test_large_nodes(spark, monkeypatch, classes):
    """Nodes beyond a task are split by histograms; with a bin for each value the tree equals the exact one."""
    monkeypatch.setattr(T, "LOCAL_ROWS", 40)
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 12, 600), rng.integers(0, 9, 600)]).astype(float)
    labels = ((x[:, 0] > 5) ^ (rng.random(600) < 0.2)).astype(float) if classes else x[:, 0] * 3 + x[:, 1] + rng.normal(size=600).round(2)
    df = frame(spark, x, labels)
    for limits in ({}, {"depth": 2}, {"leaf_rows": 30}):
        rules = T.TreeRules(classes=classes, **limits)
        model = T.Forest(rules, "id").fit(df)
        assert len(model.tops[0]["feature"]) > 1
        want = plain_tree(x, labels, np.ones(600), rules)
        got = {r.id: r.prediction for r in model.transform(df).collect()}
        values = np.array([want(row) for row in x])
        assert np.allclose([got[i] for i in range(600)], values.argmax(axis=1) if classes else values[:, 0])
    drawn = T.Forest(T.TreeRules(trees=4, classes=classes, drawn=True, columns=0.5), "id").fit(df)
    made = [r.prediction for r in drawn.transform(df).collect()]
    assert np.std(made) > 0 and abs(drawn.featureImportances.toArray().sum() - 1) < 1e-9


@pytest.mark.parametrize("classes", [0, 3])
def test_large_models_pass_the_driver_by(spark, monkeypatch, classes):
    """Trees beyond MODEL_BYTES meet the rows in tasks; the driver never collects them."""
    x, labels, _ = data(classes)
    df = frame(spark, x, labels).repartition(3)
    model = T.Forest(T.TreeRules(trees=5, classes=classes, drawn=True), "id").fit(df)
    want = {r.id: r.prediction for r in model.transform(df).collect()}
    monkeypatch.setattr(T, "MODEL_BYTES", 1)
    monkeypatch.setattr(T, "ASKED_ROWS", 60)
    monkeypatch.setattr(T.ForestModel, "_votes", None)
    got = model.transform(df.withColumn("other", F.lit("kept")))
    assert got.columns == [*df.columns, "other", "prediction"]
    assert {r.id: r.prediction for r in got.collect()} == pytest.approx(want)


def test_models_in_threads(spark, monkeypatch):
    """A search fits large tables in threads of its own, which have no active session."""
    monkeypatch.setattr(T, "LOCAL_ROWS", 20)
    x, labels, _ = data(0)
    df = frame(spark, x, labels)

    def run(_):
        model = T.Forest(T.TreeRules(columns="all"), "id").fit(df)
        return {r.id: r.prediction for r in model.transform(df).collect()}, model.featureImportances.toArray()

    with ThreadPoolExecutor(2) as pool:
        (one, shares), (two, _) = pool.map(run, range(2))
    assert one == two == run(0)[0] and abs(shares.sum() - 1) < 1e-9


def test_stored_trees_and_blocks():
    x, labels, weights = data(3)
    rules = T.TreeRules(classes=3)
    tree = T.grow(x, labels, weights, rules, np.random.default_rng(0))
    for features in (x.shape[1], 200):
        again = T._unpacked(T._packed([(0, 0, tree)], features).to_pylist()[0], 3)
        assert (again["left"] == tree["left"]).all() and np.allclose(again["value"][T.leaves(again, x)], tree["value"][T.leaves(tree, x)])
    ids = np.arange(len(x))[::-1].copy()
    blocks = [T._block(ids[a:b], x.T[:, a:b], labels[a:b]) for a, b in ((0, 70), (70, 71), (71, 150))]
    table = T.pa.table({c: T.pa.array([b[k] for b in blocks], T.pa.binary()) for k, c in enumerate(("ids", "x", "labels"))})
    back, columns, y, _ = T._rows(table)
    assert (back == np.arange(150)).all() and (T._plain(columns, slice(None)) == x[::-1]).all() and (y == labels[::-1]).all()


def test_row_weights_are_poisson():
    rules = T.TreeRules(trees=2, drawn=True)
    w = T.row_weights(np.arange(200_000), 1, rules)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.005
    assert abs(np.corrcoef(w, T.row_weights(np.arange(200_000), 0, rules))[0, 1]) < 0.01


def test_fold_votes(spark):
    x, labels, _ = data(2)
    rules = T.TreeRules(trees=6, classes=2, columns="sqrt", drawn=True)
    rows = [(p, i, [float(v) for v in x[i]], float(labels[i]), i % 3 != p, i % 3 == p) for p in range(3) for i in range(len(x))]
    table = spark.createDataFrame(rows, "part int, id long, x array<double>, label double, trained boolean, held boolean")
    got = {(r.part, r.id): r.votes for r in T.fold_votes(table, rules, 3).collect()}
    assert len(got) == len(x)
    for p in range(3):
        ids = np.arange(len(x))
        trained = ids % 3 != p
        votes = np.zeros((len(x), 2))
        for t in range(6):
            tree = T.grow(x[trained], labels[trained], T.row_weights(ids[trained], t, rules), rules, T._rng(rules, t))
            votes += tree["value"][T.leaves(tree, x)]
        assert all(np.allclose(got[p, i], votes[i]) for i in ids[~trained])
