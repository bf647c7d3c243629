"""Model, search and clustering queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog.base import VIEWS, load, query
from catalog.profile import rounded
from catalog.transform import PRIORITIES, hash_sql, scaled_sql
from tablewright.functions.session import shared_path
from tablewright.operators import cluster as C
from tablewright.operators import knn as K
from tablewright.operators import models as G
from tablewright.operators import search as H
from tablewright.operators.density import dbscan
from tablewright.operators.prep import split
from tablewright.operators.rules import leaderboard
from tablewright.plans.pipeline import benchmark, supervised_run, unsupervised_run
from tablewright.sources.sinks import save_model

KEY = "o_orderkey"
NUMERIC = ["x1", "x2", "x3"]


def class_table(spark, sf):
    return load(spark, sf, "planted").drop("y_reg")


def regression_table(spark, sf):
    return load(spark, sf, "planted").drop("y_cls")


def fitted(spark, sf, problem, model, hparams):
    """(model, metric table) of one estimator on its planted target."""
    df = class_table(spark, sf) if problem == "classification" else regression_table(spark, sf)
    return G.train_final(df, "y_cls" if problem == "classification" else "y_reg", KEY, model, hparams)


# G1-G8

MODELS = {
    "logistic_regression": ("classification", "LogisticRegression", {"C": 1.0, "max_iter": 1000}),
    "linear_regression": ("regression", "LinearRegression", {}),
    "random_forest_classifier": ("classification", "RandomForest", {
        "n_estimators": 50, "max_depth": 7, "min_samples_split": 4, "max_features": "sqrt"}),
    "random_forest_regressor": ("regression", "RandomForest", {"n_estimators": 50, "max_depth": 7, "max_features": 0.7}),
    "decision_tree_classifier": ("classification", "DecisionTree", {"max_depth": 10, "min_samples_split": 4}),
    "decision_tree_regressor": ("regression", "DecisionTree", {"max_depth": None, "min_samples_split": 10}),
    "gradient_boosting_classifier": ("classification", "GradientBoosting", {
        "n_estimators": 50, "learning_rate": 0.1, "max_depth": 3}),
    "gradient_boosting_regressor": ("regression", "GradientBoosting", {
        "n_estimators": 50, "learning_rate": 0.1, "max_depth": 3}),
    "svm_classifier_linear": ("classification", "SVM", {"C": 1.0, "kernel": "linear"}),
    "svm_classifier_rbf": ("classification", "SVM", {"C": 1.0, "kernel": "rbf"}),
    "svm_classifier_poly": ("classification", "SVM", {"C": 1.0, "kernel": "poly"}),
    "svm_regressor": ("regression", "SVM", {"C": 1.0, "kernel": "linear"}),
}
for _name, _setup in MODELS.items():
    def _model(spark, sf, setup=_setup):
        return fitted(spark, sf, *setup)[1]
    query(_name)(_model)


@query("linear_regression_one_feature", f"""with planted as ({VIEWS['planted']}) select
    round(regr_slope(y_reg, x1) * stddev_pop(x1), 6) as slope, round(avg(y_reg), 6) as intercept from planted""")
def _(spark, sf):
    model = G.fit_model(load(spark, sf, "planted"), "y_reg", "regression", "LinearRegression", numeric=["x1"])
    row = (float(model.predictor.coefficients[0]), float(model.predictor.intercept))
    return rounded(spark.createDataFrame([row], "slope double, intercept double"))


# G9

KNN_SQL = f"""with e as (select vec_id, embedding::double[] as v, label, {hash_sql('vec_id')} as h from embeddings),
    o as (select *, rank() over (order by h) - 1 as before, count(*) over () as total from e),
    s as (select *, before >= total - ceil(0.2::double * total) as test from o),
    d as (select a.vec_id, b.vec_id as neighbour, b.label, list_distance(a.v, b.v) as distance
      from s a join s b on a.test and not b.test),
    n as (select *, row_number() over (partition by vec_id order by distance, neighbour) as place from d)"""


def embedding_parts(spark, sf):
    parts = split(load(spark, sf, "embeddings"), ["vec_id"])
    return parts.where("split = 'test'"), parts.where("split = 'train'")


@query("knn_neighbours", f"{KNN_SQL} select vec_id, neighbour, round(distance, 5) as distance, place from n where place <= 5")
def _(spark, sf):
    test, train = embedding_parts(spark, sf)
    return rounded(K.knn_join(test, train, "vec_id", "vec_id", "embedding", 5), 5)


@query("knn_classifier", f"""{KNN_SQL}, c as (select vec_id, label, count(*) as n from n where place <= 5 group by 1, 2)
    select vec_id, first(label order by n desc, label) as predicted from c group by vec_id""")
def _(spark, sf):
    test, train = embedding_parts(spark, sf)
    return K.knn_predict(test, train, "vec_id", "vec_id", "embedding", "label", "classification", 5)


@query("knn_regressor", f"{KNN_SQL} select vec_id, round(avg(label), 6) as predicted from n where place <= 7 group by 1")
def _(spark, sf):
    test, train = embedding_parts(spark, sf)
    return rounded(K.knn_predict(test, train, "vec_id", "vec_id", "embedding", "label", "regression", 7))


@query("knn_model")
def _(spark, sf):
    return fitted(spark, sf, "classification", "KNN", {"n_neighbors": 5})[1]


# E5


def _prepared_sql():
    inner = scaled_sql("planted", KEY, NUMERIC)
    flags = ", ".join(f"cast(seg = '{v}' as int)::double as \"cat__seg_{v}\"" for v in PRIORITIES)
    return f"select * from ({inner}) z join (select o_orderkey, {flags} from ({VIEWS['planted']}) p) c using (o_orderkey)"


@query("prepared_features", _prepared_sql())
def _(spark, sf):
    df = load(spark, sf, "planted")
    prep = G.fit_prep(df, NUMERIC, ["seg"])
    values = vector_to_array("features")
    return prep.transform(df).select(KEY, *[(F.round(values[i], 6) + F.lit(0.0)).alias(n)
                                            for i, n in enumerate(G.feature_names(prep))])


# G10-G14, A5

@query("baselines_classification")
def _(spark, sf):
    return G.baselines(class_table(spark, sf), "y_cls", KEY)


@query("baselines_regression")
def _(spark, sf):
    return G.baselines(regression_table(spark, sf), "y_reg", KEY)


@query("feature_importances")
def _(spark, sf):
    return fitted(spark, sf, "regression", "RandomForest", {})[0].importances()


@query("top_importances", f"""with i as ({VIEWS['run_importances']}), s as (select feature, round(avg(importance), 6) as importance
    from i group by feature) select feature, importance from s order by importance desc, feature limit 3""")
def _(spark, sf):
    table = load(spark, sf, "run_importances").groupBy("feature").agg(
        F.round(F.avg("importance"), 6).alias("importance"))
    return G.top_importances(table, 3)


@query("batch_scoring")
def _(spark, sf):
    df = class_table(spark, sf)
    model = fitted(spark, sf, "classification", "DecisionTree", {"max_depth": 5})[0]
    return model.transform(df).select(KEY, "y_cls", "prediction")


@query("batch_scoring_one_feature", f"""with planted as ({VIEWS['planted']}) select o_orderkey,
    round(regr_intercept(y_reg, x1) over () + regr_slope(y_reg, x1) over () * x1, 6) as prediction from planted""")
def _(spark, sf):
    planted = load(spark, sf, "planted")
    model = G.fit_model(planted, "y_reg", "regression", "LinearRegression", numeric=["x1"])
    return rounded(model.transform(planted).select(KEY, "prediction"))


@query("model_artefact_same", "select o_orderkey, true as same from orders")
def _(spark, sf):
    df = regression_table(spark, sf)
    model = fitted(spark, sf, "regression", "DecisionTree", {"max_depth": 5})[0]
    again = G.FittedModel.load(save_model(model, shared_path(spark, "models")))
    after = again.transform(df).select(KEY, F.col("prediction").alias("reloaded"))
    return model.transform(df).join(after, KEY).select(KEY, (F.col("prediction") == F.col("reloaded")).alias("same"))


@query("model_artefact")
def _(spark, sf):
    """Rows whose prediction changes when the saved model is read back: none."""
    df = regression_table(spark, sf)
    model = fitted(spark, sf, "regression", "DecisionTree", {"max_depth": 5})[0]
    again = G.FittedModel.load(save_model(model, shared_path(spark, "models")))
    before = model.transform(df).select(KEY, "prediction")
    after = again.transform(df).select(KEY, F.col("prediction").alias("reloaded"))
    return before.join(after, KEY).select(KEY, F.round("prediction", 6).alias("prediction"),
                                          (F.col("prediction") == F.col("reloaded")).alias("same"))


# H7, K3

@query("model_search")
def _(spark, sf):
    search = H.Search(class_table(spark, sf), "y_cls", KEY, "classification")
    history, _ = H.evolve(search, model="LogisticRegression")
    search.close()
    return history


@query("model_search_trees")
def _(spark, sf):
    search = H.Search(regression_table(spark, sf), "y_reg", KEY, "regression")
    _, candidates = H.evolve(search, model="DecisionTree")
    search.close()
    return candidates


@query("model_search_v0")
def _(spark, sf):
    search = H.Search(regression_table(spark, sf), "y_reg", KEY, "regression", scoring=H.Scoring.v0())
    history, _ = H.evolve(search, model="LinearRegression", settings=H.Settings.v0())
    search.close()
    return history


@query("model_search_v0_one_feature", f"""with o as (select o_orderkey, x1, y_reg, rank() over (order by {hash_sql(KEY)}) - 1 as before, count(*) over () as total
      from ({VIEWS['planted']}) p),
    s as (select *, before >= total - ceil(0.2::double * total) as test from o),
    f as (select regr_slope(y_reg, x1) as b, regr_intercept(y_reg, x1) as a from s where not test),
    m as (select avg(y_reg) as mean from s where test),
    r as (select 1 - sum((y_reg - a - b * x1) * (y_reg - a - b * x1)) / sum((y_reg - mean) * (y_reg - mean)) as fitness from s, f, m where test)
    select gen, round(fitness, 4) as best_fitness, round(fitness, 4) as avg_fitness, 'LinearRegression' as best_model, 1 as num_features, '{{}}' as best_hparams
    from r, range(1, 6) g(gen)""")
def _(spark, sf):
    table = load(spark, sf, "planted").select(KEY, "x1", "y_reg")
    search = H.Search(table, "y_reg", KEY, "regression", scoring=H.Scoring.v0())
    history, _ = H.evolve(search, model="LinearRegression", settings=H.Settings.v0())
    search.close()
    return history.withColumn("gen", F.col("gen").cast("long"))


@query("model_search_linear_folds", f"""with o as (select o_orderkey, x1, y_reg, rank() over (order by {hash_sql(KEY)}) - 1 as before, count(*) over () as total
      from ({VIEWS['planted']}) p),
    s as (select *, least(4, case when before < (total // 5 + 1) * (total % 5) then before // (total // 5 + 1)
      else total % 5 + (before - (total // 5 + 1) * (total % 5)) // (total // 5) end) as fold from o),
    f as (select g.fold, regr_slope(y_reg, x1) as b, regr_intercept(y_reg, x1) as a from s, range(5) g(fold) where s.fold <> g.fold group by g.fold),
    m as (select fold, avg(y_reg) as mean from s group by fold),
    r as (select fold, 1 - sum((y_reg - a - b * x1) * (y_reg - a - b * x1)) / sum((y_reg - mean) * (y_reg - mean)) as r2 from s join f using (fold) join m using (fold) group by fold),
    w as (select regr_r2(y_reg, x1) as r2 from s)
    select round(avg(r.r2), 6) as mu, round(stddev_pop(r.r2), 6) as sigma, round(greatest(0, round(max(w.r2), 4) - avg(r.r2)), 6) as gap from r, w""")
def _(spark, sf):
    table = load(spark, sf, "planted").select(KEY, "x1", "y_reg")
    search = H.Search(table, "y_reg", KEY, "regression")
    got = search.evaluate(H.Candidate("LinearRegression", {}, [1]))
    search.close()
    row = tuple(got[c] for c in ("mu", "sigma", "gap"))
    return rounded(spark.createDataFrame([row], "mu double, sigma double, gap double"))


@query("benchmark_leaderboard")
def _(spark, sf):
    tables = {"planted_class": (class_table(spark, sf), "y_cls", KEY),
              "planted_regression": (regression_table(spark, sf), "y_reg", KEY)}
    return leaderboard(benchmark(tables))

@query("supervised_run")
def _(spark, sf):
    out = supervised_run(class_table(spark, sf), "y_cls", KEY, proposals=[{"name": "x12", "expr": "x1 + x2 * 0.66"}],
                         drops=["num__x3"], model="LogisticRegression")
    return out["review"]


@query("unsupervised_run")
def _(spark, sf):
    return unsupervised_run(load(spark, sf, "blobs"), "id", ["x", "y"])


# I

@query("clustering_input", scaled_sql("orders", "o_orderkey", ["o_custkey", "o_totalprice"]).replace("num__", ""))
def _(spark, sf):
    scaled = C.clustering_input(load(spark, sf, "orders"), "o_orderkey")
    return scaled.select("o_orderkey", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("o_custkey", "o_totalprice")])


ASSIGNED = f"""select id, x, y, case when id % 200 = 0 then 3 else id % 3 end as cluster from ({VIEWS['blobs']}) b"""


def assigned(spark, sf):
    return load(spark, sf, "blobs").withColumn("cluster", F.expr("case when id % 200 = 0 then 3 else id % 3 end"))


@query("silhouette", f"""with a as ({ASSIGNED}), s as (select cluster, count(*) as size from a group by cluster),
      d as (select p.id, p.cluster, q.cluster as other, sum(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))) as total
        from a p cross join a q group by 1, 2, 3),
      m as (select d.id, d.cluster, max(size) filter (where d.cluster = other) as own,
        max(total / nullif(size - 1, 0)) filter (where d.cluster = other) as a,
        min(total / size) filter (where d.cluster <> other) as b from d join s on s.cluster = other group by 1, 2)
    select count(*) as n, round(avg(case when own = 1 then 0 else (b - a) / greatest(a, b) end), 4) as silhouette from m""")
def _(spark, sf):
    return C.silhouette(assigned(spark, sf), ["x", "y"])


@query("inertia", f"""with a as ({ASSIGNED}), c as (select cluster, avg(x) as cx, avg(y) as cy from a group by cluster)
    select round(sum((x - cx) * (x - cx) + (y - cy) * (y - cy)), 2) as inertia from a join c using (cluster)""")
def _(spark, sf):
    return C.inertia(assigned(spark, sf), ["x", "y"])


@query("kmeans_sweep")
def _(spark, sf):
    scaled = C.clustering_input(load(spark, sf, "blobs"), "id", ["x", "y"])
    return C.kmeans_sweep(scaled, ["x", "y"])


def dbscan_sql(points, eps, samples):
    """CTEs up to (id, cluster): the smallest core id of the cluster, NULL for noise."""
    return f"""with recursive p as ({points}),
      near as (select a.id, b.id as other from p a join p b on b.x between a.x - {eps} and a.x + {eps}
        and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {eps}::double * {eps}::double),
      core as (select id from near group by id having count(*) >= {samples}),
      link as (select n.id, n.other from near n where n.id in (select id from core) and n.other in (select id from core)),
      walk(id, root) as (select id, id from core union select l.other, w.root from walk w join link l on l.id = w.id
        where w.root <= l.other),
      roots as (select id, min(root) as cluster from walk group by id),
      border as (select n.id, min(r.cluster) as cluster from near n join roots r on r.id = n.other
        where n.id not in (select id from core) group by n.id),
      found as (select p.id, coalesce(r.cluster, b.cluster) as cluster, case when r.id is not null then 'core'
        when b.id is not null then 'border' else 'noise' end as kind
        from p left join roots r on r.id = p.id left join border b on b.id = p.id)"""


POINTS2D = """select c_custkey as id, (c_acctbal - (select avg(c_acctbal) from customer)) /
    (select stddev_pop(c_acctbal) from customer) as x, (c_nationkey - (select avg(c_nationkey) from customer)) /
    (select stddev_pop(c_nationkey) from customer) as y from customer"""


def points2d(spark, sf):
    return (C.clustering_input(load(spark, sf, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"])
            .toDF("id", "x", "y"))


@query("dbscan", f"{dbscan_sql(POINTS2D, 0.1, 5)} select id, cluster, kind from found")
def _(spark, sf):
    return dbscan(points2d(spark, sf), "id", ["x", "y"], 0.1, 5)


@query("dbscan_dense", f"{dbscan_sql(VIEWS['blobs'], 0.5, 5)} select id, cluster, kind from found")
def _(spark, sf):
    return dbscan(load(spark, sf, "blobs"), "id", ["x", "y"], 0.5, 5)


@query("dbscan_summary", f"""{dbscan_sql(POINTS2D, 0.1, 5)}, a as (select p.id, x, y, coalesce(cluster, -1) as cluster from p join found using (id)),
      s as (select cluster, count(*) as size from a group by cluster),
      d as (select p.id, p.cluster, q.cluster as other, sum(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))) as total
        from a p cross join a q group by 1, 2, 3),
      m as (select d.id, d.cluster, max(size) filter (where d.cluster = other) as own,
        max(total / nullif(size - 1, 0)) filter (where d.cluster = other) as a,
        min(total / size) filter (where d.cluster <> other) as b from d join s on s.cluster = other group by 1, 2)
    , r as (select avg(case when own = 1 then 0 else (b - a) / greatest(a, b) end) as score,
        (select count(distinct cluster) from found) as nc, (select count(*) from found where kind = 'noise') as nz from m)
    select case when nc + least(nz, 1) > 1 and (nc + least(nz, 1) > 2 or nz = 0) then round(score, 4)
      else cast(0 as double) end as silhouette, nc as num_clusters, nz as noise_points from r""")
def _(spark, sf):
    return C.dbscan_summary(points2d(spark, sf), "id", ["x", "y"], 0.1, 5)


@query("pca_variance", """with r as (select abs(corr(o_custkey, o_totalprice)) as r from orders),
      e as (select unnest([1, 2]) as component, unnest([(1 + r) / 2, (1 - r) / 2]) as explained from r)
    select component, round(explained, 4) as explained, cast(1 as double) as total_explained from e""")
def _(spark, sf):
    names = ["o_custkey", "o_totalprice"]
    return C.pca_variance(C.clustering_input(load(spark, sf, "orders"), "o_orderkey", names), names)


@query("pca_variance_embeddings")
def _(spark, sf):
    names = [f"e{i}" for i in range(64)]
    wide = load(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].alias(n) for i, n in enumerate(names)])
    return C.pca_variance(C.clustering_input(wide, "vec_id", names), names)


@query("squared_silhouette")
def _(spark, sf):
    value = C.squared_silhouette(assigned(spark, sf), ["x", "y"])
    return rounded(spark.createDataFrame([(value,)], "squared_silhouette double"), 4)
