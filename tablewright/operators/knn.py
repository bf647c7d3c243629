"""Exact k nearest neighbours by pivot pruning.

Training rows are assigned to their nearest pivot. From the pivot distances alone each
query gets an upper bound on its k-th neighbour and the list of cells that could beat
it. Cells are cut into blocks, so a hot cell spreads over many tasks, and each task
returns only its best k per query. Copies of a vector are reduced to k before that.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tablewright.operators.prep import key_hash

PIVOTS = (64, 1024)
BLOCK_ROWS = 8192
CHUNK_ROWS = 512


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(out)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype("float64") if len(column) else np.zeros((0, 0))


def _best(queries: pd.DataFrame, train: pd.DataFrame, k: int) -> pd.DataFrame:
    """Best k training rows per query by (distance, key) within one block."""
    columns = ["q", "t", "distance"]
    if queries.empty or train.empty:
        return pd.DataFrame({"q": queries["q"].iloc[:0], "t": train["t"].iloc[:0],
                             "distance": np.zeros(0)})
    b, t = _matrix(train["v"]), train["t"].to_numpy()
    bb, last = (b * b).sum(1), min(k, len(b)) - 1
    out = []
    for start in range(0, len(queries), CHUNK_ROWS):
        part = queries.iloc[start:start + CHUNK_ROWS]
        a = _matrix(part["v"])
        aa = (a * a).sum(1)
        rough = aa[:, None] + bb[None, :] - 2 * (a @ b.T)
        kth = np.partition(rough, last, axis=1)[:, last]
        # The product form is only rough; the slack covers its rounding before the exact pass.
        slack = 1e-9 * (aa.max() + bb.max() + 1e-300)
        i, j = np.nonzero(rough <= (kth + slack)[:, None])
        exact = np.sqrt(((a[i] - b[j]) ** 2).sum(1))
        found = pd.DataFrame({"q": part["q"].to_numpy()[i], "t": t[j], "distance": exact})
        found = found.sort_values(["q", "distance", "t"], kind="stable")
        out.append(found.groupby("q", sort=False).head(k)[columns])
    return pd.concat(out)


def _summaries(train: DataFrame, k: int, pivots: int):
    """Pivot matrix, and per cell its size, radius and k smallest pivot distances."""
    chosen = train.orderBy(key_hash(["t"]), "t").limit(pivots).collect()
    centres = np.array([r["v"] for r in chosen], dtype="float64")

    @F.pandas_udf("struct<cell int, far double>")
    def nearest(v: pd.Series) -> pd.DataFrame:
        d = _distances(_matrix(v), centres)
        cell = d.argmin(axis=1) if len(d) else np.zeros(0, int)
        return pd.DataFrame({"cell": cell.astype("int32"), "far": d[np.arange(len(d)), cell]})

    placed = train.withColumn("p", nearest("v")).select("t", "v", "p.cell", "p.far")
    place = F.row_number().over(Window.partitionBy("cell").orderBy("far"))
    sizes = {r["cell"]: (r["n"], r["radius"]) for r in placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("far").alias("radius")).collect()}
    close = np.full((len(centres), k), np.inf)
    near = placed.select("cell", "far", place.alias("place")).where(F.col("place") <= k)
    for r in near.collect():  # at most pivots x k rows
        close[r["cell"], r["place"] - 1] = r["far"]
    return centres, placed, sizes, close


def knn_join(queries: DataFrame, train: DataFrame, query_key: str, train_key: str, vector: str,
             k: int = 5, pivots: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_key, neighbour, distance, place): the k nearest rows, ties to the smaller key.

    The number of pivots grows with the root of the training rows unless given.
    """
    vector_type = "array<double>"
    base = train.select(F.col(train_key).alias("t"), F.col(vector).cast(vector_type).alias("v"))
    copy = F.row_number().over(Window.partitionBy("v").orderBy("t"))
    base = base.withColumn("copy", copy).where(F.col("copy") <= k).drop("copy")
    asked = queries.select(F.col(query_key).alias("key"), F.col(vector).cast(vector_type).alias("v"))
    distinct = asked.groupBy("v").agg(F.min("key").alias("q"))

    if pivots is None:
        pivots = min(max(math.isqrt(train.count()), PIVOTS[0]), PIVOTS[1])
    centres, placed, sizes, close = _summaries(base, k, pivots)
    if not len(centres):
        raise ValueError("no training rows")
    q_type, t_type = distinct.schema["q"].dataType, base.schema["t"].dataType
    radius = np.array([sizes.get(j, (0, -np.inf))[1] for j in range(len(centres))])
    blocks = {j: max(1, math.ceil(n / block_rows)) for j, (n, _) in sizes.items()}
    shortest = len(close.ravel()) >= k

    @F.pandas_udf("array<int>")
    def visits(v: pd.Series) -> pd.Series:
        d = _distances(_matrix(v), centres)
        out = []
        for row in d:
            bound = np.partition((row[:, None] + close).ravel(), k - 1)[k - 1] if shortest else np.inf
            reach = row - radius <= bound * (1 + 1e-9) + 1e-12
            out.append(np.nonzero(reach & np.isfinite(radius))[0].astype("int32"))
        return pd.Series(out)

    routed = distinct.select("q", "v", F.explode(visits("v")).alias("cell"))
    asks = {r["cell"]: r["n"] for r in routed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    groups = {j: max(1, math.ceil(n / block_rows)) for j, n in asks.items()}

    def lookup(table: dict[int, int]):
        return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col("cell"))

    span = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = (routed.withColumn("part", F.pmod(F.xxhash64("q"), lookup(groups)).cast("int"))
            .withColumn("block", span(lookup(blocks))))
    right = (placed.where(F.col("cell").isin(list(asks)))
             .withColumn("block", F.pmod(F.xxhash64("t"), lookup(blocks)).cast("int"))
             .withColumn("part", span(lookup(groups))))
    schema = f"q {q_type.simpleString()}, t {t_type.simpleString()}, distance double"
    grouping = ["cell", "block", "part"]
    local = (left.groupBy(*grouping).cogroup(right.groupBy(*grouping))
             .applyInPandas(lambda a, b: _best(a, b, k), schema))
    order = F.row_number().over(Window.partitionBy("q").orderBy("distance", "t"))
    top = local.withColumn("place", order).where(F.col("place") <= k)
    named = distinct.join(top, "q").select("v", "t", "distance", "place")
    return (asked.join(named, "v")
            .select(F.col("key").alias(query_key), F.col("t").alias("neighbour"), "distance", "place"))


def knn_predict(queries: DataFrame, train: DataFrame, query_key: str, train_key: str, vector: str,
                label: str, problem: str, k: int = 5) -> DataFrame:
    """(query_key, predicted): majority label, the smallest on a tie, or the mean."""
    neighbours = knn_join(queries, train, query_key, train_key, vector, k)
    labels = train.select(F.col(train_key).alias("neighbour"), F.col(label).alias("label"))
    voted = neighbours.join(labels, "neighbour")
    if problem == "regression":
        return voted.groupBy(query_key).agg(F.avg("label").alias("predicted"))
    votes = voted.groupBy(query_key, "label").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("label")))
    return votes.groupBy(query_key).agg(best.alias("b")).select(query_key, F.col("b.label").alias("predicted"))
