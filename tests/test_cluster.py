import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import cluster as C
from tablewright.operators.density import connected_components, dbscan


def plain_dbscan(points, eps, samples):
    """{key: (cluster, kind)} by comparing all points."""
    keys = [p[0] for p in points]
    x = np.array([p[1:] for p in points])
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= samples
    root = {i: i for i in range(len(x)) if core[i]}
    changed = True
    while changed:
        changed = False
        for i in root:
            low = min(root[j] for j in np.nonzero(near[i])[0] if core[j])
            if low < root[i]:
                root[i], changed = low, True
    smallest = {}
    for i, r in root.items():
        smallest[r] = min(smallest.get(r, keys[i]), keys[i])
    out = {}
    for i in range(len(x)):
        if core[i]:
            out[keys[i]] = (smallest[root[i]], "core")
        else:
            around = [smallest[root[j]] for j in np.nonzero(near[i])[0] if core[j]]
            out[keys[i]] = (min(around), "border") if around else (None, "noise")
    return out


def spark_dbscan(spark, points, eps, samples):
    names = [f"c{i}" for i in range(len(points[0]) - 1)]
    df = spark.createDataFrame(points, "id long, " + ", ".join(f"{n} double" for n in names))
    return {r["id"]: (r["cluster"], r["kind"]) for r in dbscan(df, "id", names, eps, samples).collect()}


def test_dbscan_random_plane(spark):
    draw = np.random.default_rng(8)
    points = [(int(k), float(a), float(b)) for k, (a, b) in
              zip(draw.permutation(150), np.vstack([draw.normal(0, 1, (75, 2)), draw.uniform(-4, 4, (75, 2))]))]
    assert spark_dbscan(spark, points, 0.5, 4) == plain_dbscan(points, 0.5, 4)


def test_dbscan_hot_cells_and_copies(spark):
    """A third of the rows is one point; two dense cells are a hair within or beyond eps."""
    draw = np.random.default_rng(9)
    left = draw.uniform(0, 0.3, (90, 2))
    right = draw.uniform(0, 0.3, (90, 2)) + [left[:, 0].max() + 0.999 - 0.0, 0.0]
    right[:, 0] += left[:, 0].max() + 0.9 - right[:, 0].min()
    far = draw.uniform(0, 0.3, (60, 2)) + [0.0, 5.0]
    spots = np.vstack([left, right, far, np.tile([[20.0, 20.0]], (120, 1)), [[50.0, 50.0]]])
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(spots)]
    assert spark_dbscan(spark, points, 1.0, 5) == plain_dbscan(points, 1.0, 5)
    moved = [(i, x + (0.4 if 90 <= i < 180 else 0.0), y) for i, x, y in points]
    assert spark_dbscan(spark, moved, 1.0, 5) == plain_dbscan(moved, 1.0, 5)


@pytest.mark.parametrize("dims", [1, 4])
def test_dbscan_other_dimensions(spark, dims):
    draw = np.random.default_rng(10 + dims)
    points = [(i, *map(float, p)) for i, p in enumerate(draw.normal(0, 0.6, (90, dims)))]
    assert spark_dbscan(spark, points, 0.4, 4) == plain_dbscan(points, 0.4, 4)


def test_missing_coordinates_are_noise(spark):
    df = spark.createDataFrame([(i, 0.0, 0.0) for i in range(5)] + [(9, None, 0.0)], "id long, x double, y double")
    got = {r["id"]: r["kind"] for r in dbscan(df, "id", ["x", "y"]).collect()}
    assert got[9] == "noise" and got[0] == "core"


def test_components_of_a_long_path(spark):
    order = np.random.default_rng(3).permutation(60).tolist()
    nodes = spark.createDataFrame([(i,) for i in range(64)], "node long")
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(60, 61)], "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(nodes, edges).collect()}
    assert got == {**{i: 0 for i in range(60)}, 60: 60, 61: 60, 62: 62, 63: 63}


@pytest.mark.parametrize("block", [16, 100_000])
def test_silhouette_equals_all_pairs(spark, block):
    draw = np.random.default_rng(11)
    x = np.vstack([draw.normal(0, 1, (30, 2)), draw.normal(4, 1, (20, 2)), np.tile([[9.0, 9.0]], (25, 1)), [[-9.0, 0.0]]])
    labels = [0] * 30 + [1] * 20 + [2] * 25 + [3]
    distance = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    codes, scores = np.array(labels), []
    for i, c in enumerate(labels):
        own = (codes == c).sum()
        if own == 1:
            scores.append(0.0)
            continue
        a = distance[i, codes == c].sum() / (own - 1)
        b = min(distance[i, codes == o].mean() for o in set(labels) - {c})
        scores.append((b - a) / max(a, b))
    df = spark.createDataFrame([(float(p), float(q), c) for (p, q), c in zip(x, labels)], "x double, y double, cluster int")
    got = C.silhouette(df, ["x", "y"], block_rows=block).first()
    assert got["n"] == 76 and got["silhouette"] == round(float(np.mean(scores)), 4)


def plain_silhouette(x, labels):
    """Mean score by all pairs; equal clusters are few rows each, so distances are taken row by row."""
    codes = np.unique(labels, return_inverse=True)[1]
    sizes, scores = np.bincount(codes), []
    for i, c in enumerate(codes):
        sums = np.bincount(codes, weights=np.sqrt(((x - x[i]) ** 2).sum(1)))
        means = np.where(np.arange(len(sizes)) == c, np.inf, sums / sizes)
        if sizes[c] == 1:
            scores.append(0.0)
            continue
        a, b = sums[c] / (sizes[c] - 1), means.min()
        scores.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return round(float(np.mean(scores)), 4)


def test_silhouette_of_many_small_clusters(spark):
    """5,000 clusters of two points: no task holds or returns a row for each point and cluster."""
    draw = np.random.default_rng(21)
    centres = draw.uniform(-100, 100, (5000, 2))
    x = np.vstack([centres + draw.normal(0, 0.3, (5000, 2)), centres + draw.normal(0, 0.3, (5000, 2))])
    labels = np.tile(np.arange(5000), 2)
    df = spark.createDataFrame([(float(p), float(q), f"c{c}") for (p, q), c in zip(x, labels)], "x double, y double, cluster string")
    got = C.silhouette(df, ["x", "y"]).first()
    assert got["n"] == 10_000 and got["silhouette"] == plain_silhouette(x, labels)


@pytest.mark.parametrize("block", [40, 100_000])
def test_silhouette_of_nested_and_overlapping_clusters(spark, block):
    """A centre says little here: a ring around a blob, overlapping blobs, one cluster with half of the rows, three columns."""
    draw = np.random.default_rng(22)
    turn = draw.uniform(0, 2 * np.pi, 60)
    x = np.vstack([np.c_[5 * np.cos(turn), 5 * np.sin(turn), np.zeros(60)], draw.normal(0, 0.5, (40, 3)),
                   draw.normal(1, 1.5, (250, 3)), draw.normal(1.5, 1.5, (100, 3)), np.tile([[7.0, 7.0, 7.0]], (50, 1))])
    labels = np.repeat([0, 1, 2, 3, 4], [60, 40, 250, 100, 50])
    df = spark.createDataFrame([(*map(float, p), int(c)) for p, c in zip(x, labels)], "x double, y double, z double, cluster int")
    assert C.silhouette(df, ["x", "y", "z"], block_rows=block).first()["silhouette"] == plain_silhouette(x, labels)


def test_silhouette_bounds_leave_few_clusters(spark):
    """Far clusters are never visited; with more clusters than a block holds, blocks agree on the best bound."""
    draw = np.random.default_rng(23)
    rows = [(100.0 * c + float(e), 0.0, c) for c in range(30) for e in draw.normal(0, 1, 6)]
    df = spark.createDataFrame(rows, "x0 double, x1 double, cluster int")
    points = df.withColumns({"w": F.lit(1).cast("long"), "pid": F.monotonically_increasing_id()})
    clusters = df.groupBy(F.col("cluster").alias("other")).agg(
        F.count("*").alias("size"), F.var_pop("x0").alias("s"), F.avg("x0").alias("x0"), F.avg("x1").alias("x1"))
    for block in (7, 1000):
        found = C._candidates(points, clusters, ["x0", "x1"], 50, block).groupBy("pid").agg(
            F.count("*").alias("n"), F.sum(F.col("own").cast("int")).alias("own")).collect()
        assert len(found) == 180 and all(r["own"] == 1 and 2 <= r["n"] <= 3 for r in found)


def test_silhouette_of_odd_tables(spark):
    schema = "x double, y double, cluster int"
    assert tuple(C.silhouette(spark.createDataFrame([], schema), ["x", "y"]).first()) == (None, None)
    one = spark.createDataFrame([(0.0, 0.0, 1), (3.0, 4.0, 1)], schema)
    assert tuple(C.silhouette(one, ["x", "y"]).first()) == (2, 0.0)
    missing = spark.createDataFrame([(0.0, 0.0, 1), (0.0, 1.0, 1), (9.0, 0.0, 2), (None, 1.0, 2), (1.0, 1.0, None)], schema)
    plain = plain_silhouette(np.array([[0.0, 0.0], [0.0, 1.0], [9.0, 0.0]]), np.array([1, 1, 2]))
    assert tuple(C.silhouette(missing, ["x", "y"]).first()) == (3, plain)


def test_kmeans_is_a_fixed_point(spark):
    draw = np.random.default_rng(12)
    x = np.vstack([draw.normal(m, 0.3, (40, 2)) for m in (0, 4, 9)])
    df = C.with_vector(spark.createDataFrame(x.tolist(), "x double, y double"), ["x", "y"])
    model = C.best_kmeans(df, 3, starts=2)
    centres = np.array(model.clusterCenters())
    rows = model.transform(df).select("x", "y", "prediction").collect()
    points, found = np.array([(r["x"], r["y"]) for r in rows]), np.array([r["prediction"] for r in rows])
    distance = ((points[:, None] - centres[None]) ** 2).sum(-1)
    assert (distance.argmin(1) == found).all()
    assert all(np.allclose(centres[c], points[found == c].mean(0), atol=1e-3) for c in range(3))
    tagged = model.transform(df).withColumnRenamed("prediction", "cluster")
    assert abs(C.inertia(tagged, ["x", "y"]).first()[0] - distance.min(1).sum()) < 0.05
    sweep = C.kmeans_sweep(df.drop("features"), ["x", "y"], starts=1)
    assert all(-1 <= r["silhouette"] <= 1 for r in sweep.collect()) and sweep.count() == 3


def test_pca_matches_eigenvalues(spark):
    draw = np.random.default_rng(13)
    x = draw.normal(size=(200, 4)) @ draw.normal(size=(4, 4))
    df = spark.createDataFrame(x.tolist(), ", ".join(f"c{i} double" for i in range(4)))
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    got = [r["explained"] for r in C.pca_variance(df, df.columns).orderBy("component").collect()]
    assert np.allclose(got, (values / values.sum())[:3], atol=6e-5)


def test_clustering_input_fills_and_scales(spark):
    df = spark.createDataFrame([(1, 1.0, 3.0), (2, None, 3.0), (3, 5.0, 3.0)], "id long, x double, c double")
    got = C.clustering_input(df, "id").orderBy("id").collect()
    assert [round(r["x"], 6) for r in got] == [-1.224745, 0.0, 1.224745] and {r["c"] for r in got} == {0.0}


def test_dbscan_summary_of_one_cluster(spark):
    df = spark.createDataFrame([(i, 0.01 * i, 0.0) for i in range(20)], "id long, x double, y double")
    assert tuple(C.dbscan_summary(df, "id", ["x", "y"]).first()) == (0.0, 1, 0)
    assert df.agg(F.count("*")).first()[0] == 20
