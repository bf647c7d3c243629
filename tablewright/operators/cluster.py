"""Clustering input, k-means sweep, silhouette and PCA variance."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from tablewright.functions.columns import numeric_columns, ref
from tablewright.functions.session import cut_lineage, small_side
from tablewright.functions.tables import half_up, small_table
from tablewright.operators.density import dbscan
from tablewright.operators.prep import SEED, fit_numeric

BLOCK_ROWS = 16_384
CHUNK_ROWS = 512
# Distances that a task holds at once.
CHUNK_CELLS = 2_000_000
# Rounding of the bounds must not drop a cluster.
SLACK = 1 + 1e-9


def clustering_input(df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """(key, one z-scored column per numeric feature), medians in place of nulls."""
    names = columns or numeric_columns(df, exclude=(key,))
    prep = fit_numeric(df, names)
    return df.select(ref(key).alias(key), *[prep.scaled(df, c).alias(c) for c in names])


def with_vector(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.array(*[ref(c).cast("double") for c in columns])))


def best_kmeans(vectors: DataFrame, k: int, starts: int = 10, seed: int = SEED, max_iter: int = 300):
    """The lowest-cost model of several starts."""
    fitted = [KMeans(k=k, seed=seed + s, maxIter=max_iter, tol=1e-4).fit(vectors) for s in range(starts)]
    return min(fitted, key=lambda m: m.summary.trainingCost)


def inertia(assigned: DataFrame, columns: list[str], cluster: str = "cluster") -> DataFrame:
    """Sum of squared distances to the own cluster's mean, from sums alone."""
    x = [ref(c) for c in columns]
    per = assigned.groupBy(ref(cluster).alias("cluster")).agg(
        F.count("*").alias("n"), *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(x)])
    spread = sum([F.col(f"v{i}") for i in range(len(x))], F.lit(0.0))
    return per.agg(F.round(F.sum(F.col("n") * spread), 2).alias("inertia"))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of two matrices, summed over the columns' differences."""
    out = np.zeros((len(x), len(y)))
    for m in range(x.shape[1]):
        out += (x[:, m, None] - y[None, :, m]) ** 2
    return out


def _codes(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    codes = pd.factorize(pd.concat([a, b], ignore_index=True))[0]
    return codes[:len(a)], codes[len(a):]


def _candidates(points: DataFrame, clusters: DataFrame, names: list[str], rows: int, block_rows: int) -> DataFrame:
    """(pid, names, w, other, size, own): a point's own cluster and those that can be its nearest other one.

    The mean distance of a point to a cluster with centre c and mean squared distance s to c lies between
    |x - c| and sqrt(|x - c| ** 2 + s). A cluster whose lower bound is beyond another's upper bound is out.
    """
    mine, theirs = max(1, math.ceil(points.count() / rows)), max(1, math.ceil(clusters.count() / block_rows))
    left = (points.withColumn("i", F.pmod(F.xxhash64("pid"), F.lit(mine)))
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(theirs - 1)).cast("array<long>"))))
    right = (clusters.withColumn("j", F.pmod(F.xxhash64("other"), F.lit(theirs)))
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(mine - 1)).cast("array<long>"))))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        own, other = _codes(a["cluster"], b["other"])
        x, c, s = a[names].to_numpy(), b[names].to_numpy(), b["s"].to_numpy()
        step = max(1, CHUNK_CELLS // max(1, len(b)))
        at, to, low, high = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)], [np.zeros(0)]
        for start in range(0, len(a) if len(b) else 0, step):
            square = _squares(x[start:start + step], c)
            same = own[start:start + step, None] == other
            lower, upper = np.sqrt(square), np.sqrt(square + s)
            best = np.where(same, np.inf, upper).min(1)
            r, t = np.nonzero(same | (lower <= best[:, None] * SLACK))
            at.append(r + start), to.append(t), low.append(lower[r, t]), high.append(upper[r, t])
        at, to = np.concatenate(at), np.concatenate(to)
        out = a.iloc[at][["pid", *names, "w"]].reset_index(drop=True)
        chosen = b.iloc[to].reset_index(drop=True)
        return out.assign(other=chosen["other"], size=chosen["size"], own=own[at] == other[to],
                          lower=np.concatenate(low), upper=np.concatenate(high))

    kind = clusters.schema["other"].dataType.simpleString()
    schema = (f"pid long, {', '.join(f'{x} double' for x in names)}, w long, other {kind}, size long, own boolean, "
              "lower double, upper double")
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(nearest, schema)
    if theirs > 1:
        best = F.min(F.when(~F.col("own"), F.col("upper"))).over(Window.partitionBy("pid"))
        found = found.withColumn("best", best).where(F.col("own") | (F.col("lower") <= F.col("best") * SLACK))
    return found.select("pid", *names, "w", "other", "size", "own")


def _distance_sums(wanted: DataFrame, points: DataFrame, names: list[str], rows: int, block_rows: int) -> DataFrame:
    """(pid, w, other, size, own, total): distances of each wanted point to all rows of a cluster, summed.

    A large cluster is cut into blocks on both sides; small ones share tasks.
    """
    cores = points.sparkSession.sparkContext.defaultParallelism
    shared = max(cores, math.ceil(wanted.count() / rows))
    members = points.select(F.col("cluster").alias("other"), "pid", *names, "w")
    cuts = small_side(cut_lineage(
        wanted.groupBy("other").agg(F.ceil(F.count("*") / rows).alias("nl"))
        .join(members.groupBy("other").agg(F.ceil(F.count("*") / block_rows).alias("nr")), "other")))
    whole = (F.col("nl") == 1) & (F.col("nr") == 1)
    group = F.when(whole, F.pmod(F.xxhash64("other"), F.lit(shared))).otherwise(F.xxhash64("other"))

    def block(n: str):
        return F.pmod(F.xxhash64("pid"), F.col(n))

    def every(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    left = wanted.join(cuts, "other").withColumns({"g": group, "i": block("nl")}).withColumn("j", every("nr")).drop("nl", "nr")
    right = members.join(cuts, "other").withColumns({"g": group, "j": block("nr")}).withColumn("i", every("nl")).drop("nl", "nr")

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        of, to = _codes(a["other"], b["other"])
        x, y, w = a[names].to_numpy(), b[names].to_numpy(), b["w"].to_numpy().astype("float64")
        rows_by, cells_by = np.argsort(of, kind="stable"), np.argsort(to, kind="stable")
        total = np.zeros(len(a))
        for code in np.unique(of):
            asked = rows_by[slice(*np.searchsorted(of[rows_by], [code, code + 1]))]
            cells = cells_by[slice(*np.searchsorted(to[cells_by], [code, code + 1]))]
            step = max(1, CHUNK_CELLS // max(1, len(cells)))
            for start in range(0, len(asked), step):
                part = asked[start:start + step]
                total[part] = np.sqrt(_squares(x[part], y[cells])) @ w[cells]
        return a[["pid", "w", "other", "size", "own"]].assign(total=total)

    kind = members.schema["other"].dataType.simpleString()
    local = left.groupBy("g", "i", "j").cogroup(right.groupBy("g", "i", "j")).applyInPandas(
        sums, f"pid long, w long, other {kind}, size long, own boolean, total double")
    return local.groupBy("pid", "w", "other", "size", "own").agg(F.sum("total").alias("total"))


def silhouette(assigned: DataFrame, columns: list[str], cluster: str = "cluster",
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(n, silhouette) with Euclidean distances between all rows.

    Equal rows of a cluster are merged with a weight. Bounds by centres and variances leave few clusters that can be
    a point's nearest other one, and distances are summed over these and its own cluster only. A task holds two
    blocks of rows. Rows without a cluster or with a missing coordinate are left out; with one cluster the score is 0.
    """
    names = [f"x{i}" for i in range(len(columns))]
    rows = assigned.select(ref(cluster).alias("cluster"),
                           *[ref(c).cast("double").alias(x) for c, x in zip(columns, names)]).dropna()
    points = cut_lineage(rows.groupBy("cluster", *names).agg(F.count("*").alias("w"))
                         .withColumn("pid", F.monotonically_increasing_id()))
    spread = sum([F.var_pop(x) for x in names], F.lit(0.0))
    clusters = cut_lineage(rows.groupBy(F.col("cluster").alias("other")).agg(
        F.count("*").alias("size"), spread.alias("s"), *[F.avg(x).alias(x) for x in names]))
    # Blocks enough to use every core, each within the block size.
    cores = assigned.sparkSession.sparkContext.defaultParallelism
    task_rows = min(block_rows, max(CHUNK_ROWS, math.ceil(points.count() / cores)))
    wanted = cut_lineage(_candidates(points, clusters, names, task_rows, block_rows))
    sums = _distance_sums(wanted, points, names, task_rows, block_rows)
    own = F.col("own")
    per_row = sums.groupBy("pid", "w").agg(
        F.max(F.when(own, F.col("size"))).alias("own_size"),
        F.max(F.when(own, F.try_divide(F.col("total"), F.col("size") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("size"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    score = F.when(F.col("own_size") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    return per_row.agg(F.sum("w").alias("n"),
                       F.round(F.try_divide(F.sum(score * F.col("w")), F.sum("w")), 4).alias("silhouette"))


def squared_silhouette(assigned: DataFrame, columns: list[str], cluster: str = "cluster") -> float:
    """Spark's own silhouette on squared distances: one pass, for tables too large for all pairs."""
    scored = with_vector(assigned, columns).withColumn("prediction", ref(cluster).cast("int"))
    return ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(scored)


def kmeans_sweep(scaled: DataFrame, columns: list[str], ks=(2, 3, 5), starts: int = 10) -> DataFrame:
    """(model, silhouette, inertia) per k on already scaled columns."""
    vectors = with_vector(scaled, columns).persist()
    rows = []
    for k in ks:
        model = best_kmeans(vectors, k, starts)
        assigned = model.transform(vectors).withColumnRenamed("prediction", "cluster")
        score = silhouette(assigned, columns).first()["silhouette"]
        rows.append((f"KMeans (k={k})", score, half_up(model.summary.trainingCost, 2)))
    vectors.unpersist()
    return small_table(scaled.sparkSession, rows, "model string, silhouette double, inertia double")


def dbscan_summary(scaled: DataFrame, key: str, columns: list[str], eps: float = 0.5,
                   min_samples: int = 5) -> DataFrame:
    """(silhouette, num_clusters, noise_points); noise counts as a cluster in the silhouette."""
    found = dbscan(scaled, key, columns, eps, min_samples)
    labelled = scaled.join(found, key).persist()
    counts = labelled.agg(F.count_distinct("cluster").alias("clusters"),
                          F.count(F.when(F.col("kind") == "noise", 1)).alias("noise")).first()
    labels = counts["clusters"] + (1 if counts["noise"] else 0)
    score = 0.0
    if labels > 1 and (labels > 2 or not counts["noise"]):
        tagged = labelled.withColumn("tag", F.coalesce(F.col("cluster").cast("string"), F.lit("noise")))
        score = silhouette(tagged, columns, "tag").first()["silhouette"]
    labelled.unpersist()
    return small_table(scaled.sparkSession, [(score, counts["clusters"], counts["noise"])],
                       "silhouette double, num_clusters long, noise_points long")


def pca_variance(scaled: DataFrame, columns: list[str], components: int = 3) -> DataFrame:
    """(component, explained ratio, total ratio) of the leading components."""
    k = min(len(columns), components)
    model = PCA(k=k, inputCol="features", outputCol="pca").fit(with_vector(scaled, columns))
    ratios = [float(v) for v in model.explainedVariance]
    total = half_up(sum(ratios), 4)
    return small_table(scaled.sparkSession, [(i + 1, half_up(v, 4), total) for i, v in enumerate(ratios)],
                       "component int, explained double, total_explained double")
