"""Near-duplicate embeddings by cross-polytope hashing, with every link verified."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.components import components
from tablewright.llm.frames import one_row_per_key, quoted, small_or_not, stored

# Hash functions for a bucket, and buckets besides its own that a vector is put into. Two unrelated vectors of 64 numbers meet
# with probability 1e-4, two at cosine 0.9 with 0.999; five functions are due from 1e7 vectors on.
FUNCTIONS, PROBES = 4, 12


def tables_for(size: int) -> int:
    """Tables of buckets for vectors of a width: the wider they are, the less often one table brings two near ones together."""
    return max(12, 4 * max(0, size - 1).bit_length() - 20)


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x


def buckets(x: np.ndarray, tables: int | None = None, functions: int = FUNCTIONS, probes: int = PROBES, seed: int = 5) -> np.ndarray:
    """Keys of the 1 + `probes` buckets of each row in each table.

    A function flips signs and applies a fast Hadamard transform, three times; its value is the largest coordinate
    by size, with its sign. The probes change one function's value to the next largest, the smallest losses first.
    """
    n, size = x.shape
    tables = tables or tables_for(size)
    width = 1 << max(0, size - 1).bit_length()
    padded = np.zeros((n, width), dtype=np.float64)
    padded[:, :size] = x / np.linalg.norm(x, axis=1, keepdims=True)
    random = np.random.default_rng(seed + 1009 * size)
    keys = np.zeros((n, tables, 1 + probes), dtype=np.uint64)
    depth = min(width, probes // functions + 1)
    for table in range(tables):
        codes, losses = [], []
        for _ in range(functions):
            y = padded
            for _ in range(3):
                y = _hadamard(y * random.choice([-1.0, 1.0], size=width)) / math.sqrt(width)
            strength = np.abs(y)
            order = np.argsort(-strength, axis=1, kind="stable")[:, :depth]
            chosen = np.take_along_axis(strength, order, 1)
            codes.append((2 * order + (np.take_along_axis(y, order, 1) < 0)).astype(np.uint64))
            losses.append(chosen[:, :1] ** 2 - chosen ** 2)
        def key(picked):
            out = np.full(n, table * 1_000_003 + size, dtype=np.uint64)
            for code in picked:
                out = (out ^ code) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
            return out

        keys[:, table, 0] = key([c[:, 0] for c in codes])
        options = [(f, j) for f in range(functions) for j in range(1, depth)]
        if options:
            loss = np.stack([losses[f][:, j] for f, j in options], axis=1)
            every = np.stack([key([c[:, j if i == f else 0] for i, c in enumerate(codes)]) for f, j in options], axis=1)
            best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
            taken = np.take_along_axis(every, best, 1)
            keys[:, table, 1:1 + taken.shape[1]] = taken
            keys[:, table, 1 + taken.shape[1]:] = keys[:, table, :1]
        else:
            keys[:, table, 1:] = keys[:, table, :1]
    return keys.reshape(n, -1)


def _matrices(column: pa.Array):
    """(rows, matrix) for each length of the vectors in a list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    begins = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[begins[rows][:, None] + np.arange(size)]


def _hashed(vectors: DataFrame, tables: int | None, functions: int, probes: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for rows, matrix in _matrices(batch.column("vector")):
                keys = buckets(matrix, tables, functions, probes)
                ends = np.arange(len(rows) + 1, dtype=np.int32) * keys.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows)), lists], ["key", "buckets"])

    return vectors.select("key", "vector").mapInArrow(run, "key long, buckets array<long>").select("key", F.explode(F.array_distinct("buckets")).alias("bucket"))


def _cosines(pairs: DataFrame, keep: str) -> DataFrame:
    """Adds the cosine of va and vb (vectors of one length, double precision) to the columns that `keep` describes."""
    names = [field.split()[0] for field in keep.split(", ")]

    def run(batches):
        for batch in batches:
            cosine = np.zeros(batch.num_rows)
            for (rows, a), (_, b) in zip(_matrices(batch.column("va")), _matrices(batch.column("vb"))):
                dot = np.einsum("ij,ij->i", a, b)
                cosine[rows] = dot / np.sqrt(np.einsum("ij,ij->i", a, a)) / np.sqrt(np.einsum("ij,ij->i", b, b))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(cosine)], [*names, "cosine"])

    return pairs.select(*names, "va", "vb").mapInArrow(run, keep + ", cosine double")


def _angle(cosine: str):
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col(cosine))))


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9,
                 tables: int | None = None, functions: int = FUNCTIONS, probes: int = PROBES) -> DataFrame:
    """Key, n_links, component_id (smallest key reachable by links, itself included) and kept (key = component_id).

    Vectors are linked when they share a bucket, or their groups do, and their cosine in double precision is at
    least `least`. Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing, nor do
    vectors of different lengths. Rows that repeat a key are one vector (the smallest); rows with a null key come
    back with no links, a null component and kept true. An empty table gives an empty result.

    Hot groups: equal vectors count once, with a weight. Vectors within half the angle of a link from a head (the
    smallest key of a bucket) form its ball, in which all are linked without looking at pairs. Balls that meet in a
    bucket are compared by their heads and radii, then each vector with the other head, and only where that
    leaves it open with the other ball's vectors, so that all links between two balls that meet are counted.
    """
    limit = math.acos(least)
    near = limit / 2 - 1e-9
    rows = one_row_per_key(df.select(quoted(key).cast("long").alias("key"), quoted(vector).cast("array<double>").alias("vector")))
    x = F.col("vector")
    fits = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = stored(rows.withColumn("fits", F.coalesce(fits, F.lit(False)) & F.col("key").isNotNull()), "vectors")
    ids = rows.filter("fits").select("key", F.xxhash64("vector").alias("h1"), F.xxhash64("vector", F.lit(1)).alias("h2"))
    equal = stored(ids.groupBy("h1", "h2").agg(F.min("key").alias("rep"), F.count("*").alias("weight")), "equal")
    reps = stored(rows.join(equal.select(F.col("rep").alias("key"), "weight"), "key").select("key", "vector", "weight"), "reps")

    hashed = _hashed(reps, tables, functions, probes)
    leaders = hashed.groupBy("bucket").agg(F.min("key").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("bucket", "leader")
    entries = stored(hashed.join(leaders, "bucket"), "entries")

    def with_vectors(pairs, a, b):
        first = reps.select(F.col("key").alias(a), F.col("vector").alias("va"))
        return pairs.join(first, a).join(reps.select(F.col("key").alias(b), F.col("vector").alias("vb")), b)

    met = entries.filter("key <> leader").select("key", "leader").distinct()
    close = _cosines(with_vectors(met, "key", "leader"), "key long, leader long").withColumn("angle", _angle("cosine")).filter(F.col("angle") <= near)
    close = stored(close.select("key", "leader", "angle"), "close")
    heads = close.select(F.col("leader").alias("head")).distinct().join(close.select(F.col("key").alias("head")).distinct(), "head", "left_anti")
    chosen = (close.join(heads.withColumnRenamed("head", "leader"), "leader").groupBy("key")
              .agg(F.min(F.struct("leader", "angle")).alias("best")).select("key", "best.leader", "best.angle"))
    members = stored(reps.join(chosen, "key", "left").select(
        "key", "weight", "vector", F.coalesce("leader", "key").alias("head"), F.coalesce("angle", F.lit(0.0)).alias("angle")), "members")
    balls = stored(members.groupBy("head").agg(F.sum("weight").alias("total"), F.max("angle").alias("radius"))
                   .join(reps.select(F.col("key").alias("head"), "vector"), "head"), "balls")

    spots = entries.select("key", "bucket").join(members.select("key", "head"), "key").select("bucket", "head").distinct()
    meeting = (spots.withColumnRenamed("head", "h1").join(spots.withColumnRenamed("head", "h2"), "bucket")
               .filter("h1 < h2").select("h1", "h2").distinct())
    sided = (meeting.join(balls.select(F.col("head").alias("h1"), F.col("vector").alias("va"), F.col("radius").alias("r1")), "h1")
             .join(balls.select(F.col("head").alias("h2"), F.col("vector").alias("vb"), F.col("radius").alias("r2")), "h2"))
    touching = stored(_cosines(sided, "h1 long, h2 long, r1 double, r2 double").filter(
        _angle("cosine") - F.col("r1") - F.col("r2") <= limit + 1e-9).select("h1", "h2"), "touching")
    both = touching.unionByName(touching.select(F.col("h2").alias("h1"), F.col("h1").alias("h2")))
    both = small_or_not(stored(both, "both"))
    faced = (members.select("key", F.col("head").alias("h1"), F.col("vector").alias("va")).join(both, "h1")
             .join(balls.select(F.col("head").alias("h2"), F.col("vector").alias("vb"), F.col("radius").alias("r2"), "total"), "h2"))
    faced = stored(_cosines(faced, "key long, h1 long, h2 long, r2 double, total long").withColumn("angle", _angle("cosine")), "faced")
    whole = faced.filter(F.col("angle") + F.col("r2") <= limit - 1e-9)
    part = faced.filter((F.col("angle") + F.col("r2") > limit - 1e-9) & (F.col("angle") - F.col("r2") <= limit + 1e-9)).select("key", "h2")
    pairs = part.join(reps.select("key", F.col("vector").alias("va")), "key").join(
        members.select(F.col("key").alias("other"), F.col("head").alias("h2"), F.col("vector").alias("vb"), "weight"), "h2")
    pairs = stored(_cosines(pairs, "key long, other long, weight long").filter(F.col("cosine") >= least), "pairs")

    counts = [members.join(balls.select("head", "total"), "head").select("key", (F.col("total") - 1).alias("n")),
              whole.select("key", F.col("total").alias("n")), pairs.select("key", F.col("weight").alias("n"))]
    links = reduce(DataFrame.unionByName, counts).groupBy("key").agg(F.sum("n").alias("n_links"))
    edges = [members.select(F.col("key").alias("u"), F.col("head").alias("v")), whole.select(F.col("key").alias("u"), F.col("h2").alias("v")),
             pairs.select(F.col("key").alias("u"), F.col("other").alias("v"))]
    found = components(reduce(DataFrame.unionByName, edges))
    classes = (equal.join(links.withColumnRenamed("key", "rep"), "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
               .select("h1", "h2", "n_links", F.coalesce("component", "rep").alias("component")))
    linked = ids.join(classes, ["h1", "h2"]).select("key", "n_links", F.col("component").alias("component_id"))
    alone = rows.filter("not fits").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return (linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)))
            .withColumnRenamed("key", key))
