"""Classification and regression metrics over prediction tables, grouped or whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.columns import ref

CLASS_METRICS = ("accuracy", "f1_macro", "precision_macro", "recall_macro")
REGRESSION_METRICS = ("mse", "rmse", "mae", "r2")


def _rounded(column: Column, digits: int | None) -> Column:
    return column if digits is None else F.round(column, digits)


def confusion(predictions: DataFrame, label: str = "label", pred: str = "pred", by=()) -> DataFrame:
    """Rows per (label, pred); the only step that touches every prediction."""
    return (predictions.groupBy(*by, ref(label).alias("label"), ref(pred).alias("pred"))
            .agg(F.count("*").alias("n")))


def class_scores(predictions: DataFrame, label: str = "label", pred: str = "pred", by=()) -> DataFrame:
    """Precision, recall and F1 of every label seen in truth or prediction; 0 if undefined."""
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("label").eqNullSafe(F.col("pred")), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")))
    per_class = (confusion(predictions, label, pred, by).select(*by, F.inline(sides))
                 .groupBy(*by, "class")
                 .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")]))
    hits, zero = F.col("hits"), F.lit(0.0)
    return per_class.select(
        "*",
        F.coalesce(F.try_divide(hits, "predicted"), zero).alias("precision"),
        F.coalesce(F.try_divide(hits, "support"), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * hits, F.col("predicted") + F.col("support")), zero).alias("f1"))


def classification_metrics(predictions: DataFrame, label: str = "label", pred: str = "pred",
                           by=(), digits: int | None = 4) -> DataFrame:
    """One row per group: accuracy and unweighted means over the classes."""
    return (class_scores(predictions, label, pred, by).groupBy(*by)
            .agg(_rounded(F.try_divide(F.sum("hits"), F.sum("support")), digits).alias("accuracy"),
                 _rounded(F.avg("f1"), digits).alias("f1_macro"),
                 _rounded(F.avg("precision"), digits).alias("precision_macro"),
                 _rounded(F.avg("recall"), digits).alias("recall_macro")))


def regression_metrics(predictions: DataFrame, label: str = "label", pred: str = "pred",
                       by=(), digits: int | None = 4) -> DataFrame:
    """One row per group; RMSE is the root of the already rounded MSE."""
    y, p = ref(label).cast("double"), ref(pred).cast("double")
    sums = predictions.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((y - p) * (y - p)).alias("mse"),
        F.avg(F.abs(y - p)).alias("mae"), F.var_pop(y).alias("variance"),
        F.min(y).alias("low"), F.max(y).alias("high"))
    flat = F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    r2 = F.when(F.col("n") < 2, None).when(F.col("low") == F.col("high"), flat) \
        .otherwise(1 - F.try_divide(F.col("mse"), F.col("variance")))
    return sums.select(*by, _rounded(F.col("mse"), digits).alias("mse"),
                       _rounded(F.sqrt(_rounded(F.col("mse"), digits)), digits).alias("rmse"),
                       _rounded(F.col("mae"), digits).alias("mae"), _rounded(r2, digits).alias("r2"))


def metrics(predictions: DataFrame, problem: str, label: str = "label", pred: str = "pred",
            by=(), digits: int | None = 4) -> DataFrame:
    """Metrics of either problem type; one job for all groups of `by`."""
    score = classification_metrics if problem == "classification" else regression_metrics
    return score(predictions, label, pred, by, digits)


def overfitting_gap(table: DataFrame, problem: str, by=("model",)) -> DataFrame:
    """Train and validation rows side by side: accuracy falls, or RMSE rises, by the gap."""
    name = "accuracy" if problem == "classification" else "rmse"
    side = lambda s: F.max(F.when(F.col("split") == s, F.col(name)))
    train, held_out = side("train"), side("test")
    gap = train - held_out if problem == "classification" else held_out - train
    return table.groupBy(*by).agg(F.round(gap, 4).alias("overfitting_gap"))


def primary_scores(table: DataFrame, problem: str, by=("model",)) -> DataFrame:
    """Train and test value of the score a run is judged by."""
    name = "accuracy" if problem == "classification" else "r2"
    return table.groupBy(*by).agg(*[
        F.max(F.when(F.col("split") == s, F.col(name))).alias(f"{s}_score") for s in ("train", "test")])
