"""Helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.functions.session import BROADCAST_ROWS, bound_batches, shared_path
from tablewright.llm.textblocks import released


def quoted(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, use) -> Column:
    """`use` applied to a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def in_batches(df: DataFrame, run: Callable, kinds: str) -> DataFrame:
    """`run` over Arrow batches that are bounded in bytes; workers give memory back after each partition."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(released(run), kinds)


# Rows of numbers that are worth a file of their own.
FILE_ROWS = 500_000


def stored(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, safe when executors are lost.

    With `rows`, about how many rows of a few numbers there are, it gets no more files than these need.
    """
    path = shared_path(df.sparkSession, label)
    if rows is not None:
        df = df.coalesce(rows // FILE_ROWS + 1)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_row_per_key(df: DataFrame) -> DataFrame:
    """Rows (key, payload...) as they are when no key repeats, else the smallest payload of each key; null keys stay."""
    repeated = df.filter("key is not null").groupBy("key").count().filter("count > 1")
    if repeated.isEmpty():
        return df
    least = [F.min(F.struct(*[c for c in df.columns if c != "key"])).alias("row")]
    unique = df.filter("key is not null").groupBy("key").agg(*least).select("key", "row.*")
    return unique.unionByName(df.filter("key is null"))


def small_or_not(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it is counted to have at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
