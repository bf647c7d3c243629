"""Preprocessing pipeline, estimators, baselines, final model and importances."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel, Transformer, classification, regression
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import (
    IndexToString, OneHotEncoder, PolynomialExpansion, SQLTransformer, StringIndexer, VectorAssembler)
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.functions.columns import ref, scrub_nonfinite
from tablewright.functions.session import spread
from tablewright.functions.tables import half_up, small_table
from tablewright.operators import metrics as M
from tablewright.operators.forest import Forest, ForestModel, TreeRules
from tablewright.operators.knn import knn_predict
from tablewright.operators.prep import SEED, column_modes, fit_numeric, split
from tablewright.operators.profile import Profile
from tablewright.operators.svm import KEPT_CELLS, FourierFeatures, SvcModel, fit_svc, fit_svr, kernel_scale

# The deepest tree that Spark's boosting grows.
OPEN_DEPTH = 30
# One-against-the-rest fits that run side by side.
FITS_AT_ONCE = 4
# The indexer keeps a column's categories on the driver.
MAX_CATEGORIES = 100_000
TREE_MODELS = ("RandomForest", "DecisionTree", "GradientBoosting")


# Stands for a dot, which the ML stages would read as a nested field.
DOT = "\u2024"


def _slot(prefix: str, column: str) -> str:
    return prefix + column.replace(".", DOT)


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(value: float) -> str:
    return f"double('{value!r}')"


def fit_prep(df: DataFrame, numeric: list[str], categorical: list[str]) -> PipelineModel:
    """Median fill and scaling, mode fill and one-hot, assembled into `features`."""
    fitted = fit_numeric(df, numeric)
    modes = column_modes(df, categorical)
    categorical = [c for c in categorical if modes[c] is not None]
    if categorical:
        sizes = df.agg(*[F.approx_count_distinct(ref(c)).alias(f"a{i}") for i, c in enumerate(categorical)]).first()
        wide = [c for c, n in zip(categorical, sizes) if n > MAX_CATEGORIES]
        if wide:
            raise ValueError(f"over {MAX_CATEGORIES} categories in {wide}; leave these columns out")
    parts = []
    for c in numeric:
        x = f"cast({_name(c)} as double)"
        clean = f"case when not isnan({x}) and abs({x}) < double('infinity') then {x} end"
        median = fitted.medians[c]
        filled = f"coalesce({clean}, {_number(0.0 if median is None else median)})"
        parts.append(f"({filled} - {_number(fitted.means[c])}) / {_number(fitted.scales[c])} "
                     f"as {_name(_slot('num__', c))}")
    for c in categorical:
        parts.append(f"coalesce(cast({_name(c)} as string), {_text(str(modes[c]))}) "
                     f"as {_name(_slot('fill__', c))}")
    stages = [SQLTransformer(statement=f"select *, {', '.join(parts)} from __THIS__")]
    inputs = [_slot("num__", c) for c in numeric]
    if categorical:
        stages += [
            StringIndexer(inputCols=[_slot("fill__", c) for c in categorical],
                          outputCols=[_slot("idx__", c) for c in categorical],
                          stringOrderType="alphabetAsc", handleInvalid="keep"),
            OneHotEncoder(inputCols=[_slot("idx__", c) for c in categorical],
                          outputCols=[_slot("cat__", c) for c in categorical], dropLast=True)]
        inputs += [_slot("cat__", c) for c in categorical]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return Pipeline(stages=stages).fit(df)


def feature_names(prep: PipelineModel) -> list[str]:
    """Names of the vector's slots: num__x, then cat__x_value."""
    indexers = [s for s in prep.stages if hasattr(s, "labelsArray")]
    labels = {}
    for s in indexers:
        labels.update(zip((c.replace("idx__", "cat__", 1) for c in s.getOutputCols()), s.labelsArray))
    out = []
    for c in prep.stages[-1].getInputCols():
        name = c.replace(DOT, ".")
        out += [f"{name}_{v}" for v in labels[c]] if c in labels else [name]
    return out


def tree_rules(model: str, problem: str, hparams: dict, classes: int) -> TreeRules:
    """How the trees of a forest or a single tree grow."""
    classify = problem == "classification"
    common = {"depth": hparams.get("max_depth"), "split_rows": hparams.get("min_samples_split", 2),
              "leaf_rows": hparams.get("min_samples_leaf", 1), "classes": classes if classify else 0, "seed": SEED}
    if model == "DecisionTree":
        return TreeRules(**common)
    return TreeRules(trees=hparams.get("n_estimators", 100), drawn=True,
                     columns=hparams.get("max_features", "sqrt" if classify else "all"), **common)


def make_estimator(model: str, problem: str, hparams: dict, rows: int, classes: int, key: str | None = None):
    """The estimator of a model name and its hyper-parameters."""
    classify = problem == "classification"
    if model in ("RandomForest", "DecisionTree"):
        return Forest(tree_rules(model, problem, hparams, classes), key)
    if model == "GradientBoosting":
        depth = hparams.get("max_depth", 3) or OPEN_DEPTH
        if depth > OPEN_DEPTH:
            raise ValueError(f"Spark boosts trees to depth {OPEN_DEPTH}, not {depth}")
        leaf = max(hparams.get("min_samples_leaf", 1), math.ceil(hparams.get("min_samples_split", 2) / 2))
        boost = {"maxIter": hparams.get("n_estimators", 100), "maxDepth": depth, "stepSize": hparams.get("learning_rate", 0.1),
                 "minInstancesPerNode": leaf, "seed": SEED, "maxMemoryInMB": 1024}
        if not classify:
            return GBTRegressor(**boost)
        single = GBTClassifier(**boost)
        return single if classes <= 2 else OneVsRest(classifier=single, parallelism=FITS_AT_ONCE)
    if model == "LogisticRegression":
        return LogisticRegression(regParam=1 / (hparams.get("C", 1.0) * rows), elasticNetParam=0.0,
                                  standardization=False, maxIter=hparams.get("max_iter", 1000),
                                  family="auto" if classes <= 2 else "multinomial")
    if model == "SVM" and classify:
        single = LinearSVC(regParam=1 / (hparams.get("C", 1.0) * rows), standardization=False, maxIter=100,
                           tol=1e-3)
        return single if classes <= 2 else OneVsRest(classifier=single, parallelism=FITS_AT_ONCE)
    if model == "LinearRegression":
        return LinearRegression(solver="normal", regParam=0.0)
    raise ValueError(f"no {problem} estimator named {model!r}")


class KnnModel:
    """Neighbours are looked up in the training vectors kept as a table."""

    def __init__(self, train: DataFrame, key: str, problem: str, k: int):
        self.train, self.key, self.problem, self.k = train, key, problem, k

    def transform(self, df: DataFrame) -> DataFrame:
        dense = lambda t: t.withColumn("_v", vector_to_array("features"))
        found = knn_predict(dense(df), dense(self.train), self.key, self.key, "_v", "label",
                            self.problem, self.k)
        return df.join(found.withColumnRenamed("predicted", "prediction"), self.key)


@dataclass
class FittedModel:
    """Preprocessing, optional kernel features, predictor and class labels."""
    model: str
    problem: str
    prep: PipelineModel
    predictor: object
    labels: list[str] | None
    target: str
    expand: Transformer | FourierFeatures | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds `prediction`; for classes as the label text."""
        out = self.prep.transform(df)
        if self.expand is not None:
            out = self.expand.transform(out).withColumn("features", F.col("expanded")).drop("expanded")
        out = self.predictor.transform(out)
        kept = out.select(*[ref(c) for c in df.columns], F.col("prediction"))
        if self.labels is None:
            return kept
        named = IndexToString(inputCol="prediction", outputCol="_named", labels=self.labels).transform(kept)
        return named.drop("prediction").withColumnRenamed("_named", "prediction")

    def importances(self) -> DataFrame:
        """(feature, importance) of tree models; empty for the others."""
        values = getattr(self.predictor, "featureImportances", None)
        rows = []
        if values is not None:
            names = feature_names(self.prep)
            names = names if len(names) == values.size else [f"feature_{i}" for i in range(values.size)]
            rows = [(n, half_up(float(v), 4)) for n, v in zip(names, values.toArray())]
        return small_table(_session(), rows, "feature string, importance double")

    def save(self, path: str) -> None:
        """Preprocessing and predictor as Spark ML files, the rest as one JSON row."""
        if isinstance(self.predictor, KnnModel):
            raise ValueError("a kNN model is its training table; write that table instead")
        self.prep.write().overwrite().save(f"{path}/prep")
        if isinstance(self.predictor, (ForestModel, SvcModel)):
            self.predictor.save(f"{path}/predictor")
        else:
            self.predictor.write().overwrite().save(f"{path}/predictor")
        meta = {"model": self.model, "problem": self.problem, "labels": self.labels,
                "target": self.target, "class": type(self.predictor).__name__, "expand": None}
        if isinstance(self.expand, FourierFeatures):
            meta["expand"] = self.expand.to_dict()
        elif self.expand is not None:
            meta["expand"] = {"degree": self.expand.getDegree()}
        spark = _session()
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode(
            "overwrite").text(f"{path}/meta")

    @staticmethod
    def load(path: str) -> "FittedModel":
        meta = json.loads(_session().read.text(f"{path}/meta").first()[0])
        own = {"ForestModel": ForestModel, "SvcModel": SvcModel}
        kind = own.get(meta["class"]) or getattr(classification, meta["class"], None) or getattr(regression, meta["class"])
        expand = meta["expand"]
        if expand is not None:
            expand = FourierFeatures(**expand) if "seed" in expand else _polynomial(expand["degree"])
        return FittedModel(meta["model"], meta["problem"], PipelineModel.load(f"{path}/prep"),
                           kind.load(f"{path}/predictor"), meta["labels"], meta["target"], expand)


def _session():
    return SparkSession.getActiveSession()


def _polynomial(degree: int) -> PolynomialExpansion:
    return PolynomialExpansion(degree=degree, inputCol="features", outputCol="expanded")


def index_labels(df: DataFrame, target: str) -> tuple[DataFrame, list[str]]:
    """Adds `label`, the position of the class in text order."""
    text = df.withColumn("_target", ref(target).cast("string"))
    fitted = StringIndexer(inputCol="_target", outputCol="label", stringOrderType="alphabetAsc").fit(text)
    return fitted.transform(text).drop("_target"), list(fitted.labels)


def fit_model(train: DataFrame, target: str, problem: str, model: str, hparams: dict | None = None,
              numeric: list[str] = (), categorical: list[str] = (), key: str | None = None,
              prep: PipelineModel | None = None) -> FittedModel:
    """Fit one model on the rows that have a target."""
    hparams = dict(hparams or {})
    train = scrub_nonfinite(train).where(ref(target).isNotNull())
    prep = prep or fit_prep(train, list(numeric), list(categorical))
    vectors = prep.transform(train)
    labels = None
    if problem == "classification":
        vectors, labels = index_labels(vectors, target)
    else:
        vectors = vectors.withColumn("label", ref(target).cast("double"))
    slim = vectors.select("features", "label", *([ref(key)] if key else []))
    if model == "KNN":
        if key is None:
            raise ValueError("kNN needs a key column")
        predictor = KnnModel(slim, key, problem, hparams.get("n_neighbors", 5))
        return FittedModel(model, problem, prep, predictor, labels, target)
    slim = spread(slim).persist()
    expand = None
    if model == "SVM" and hparams.get("kernel", "linear") != "linear":
        if hparams["kernel"] == "rbf":
            rows = slim.count()
            expand = FourierFeatures(len(feature_names(prep)), kernel_scale(slim))
            if problem == "classification" and rows * expand.size > KEPT_CELLS:
                predictor = fit_svc(slim, expand, hparams.get("C", 1.0), rows, len(labels))
                slim.unpersist()
                return FittedModel(model, problem, prep, predictor, labels, target)
        else:
            expand = _polynomial(3)
        fit_on = expand.transform(slim).withColumn("features", F.col("expanded")).persist()
    else:
        fit_on = slim
    if model == "SVM" and problem == "regression":
        predictor = fit_svr(fit_on, hparams.get("C", 1.0))
    else:
        rows = slim.count()
        predictor = make_estimator(model, problem, hparams, rows, len(labels or []), key).fit(fit_on)
    if expand is not None:
        fit_on.unpersist()
    slim.unpersist()
    return FittedModel(model, problem, prep, predictor, labels, target, expand)


def scored(fitted: FittedModel, df: DataFrame) -> DataFrame:
    """(model, split, label, pred) rows for the metric operators."""
    out = fitted.transform(df)
    label = ref(fitted.target).cast("string" if fitted.problem == "classification" else "double")
    return out.select(F.lit(fitted.model).alias("model"), "split", label.alias("label"),
                      F.col("prediction").alias("pred"))


def routed_columns(profile: Profile) -> tuple[list[str], list[str]]:
    """Numeric and categorical features; boolean, datetime and text columns are left out."""
    kinds = profile.kinds
    return ([c for c, k in kinds.items() if k == "numerical"],
            [c for c, k in kinds.items() if k == "categorical"])


def baselines(df: DataFrame, target: str, key: str, profile: Profile | None = None,
              forest: dict | None = None) -> DataFrame:
    """(model, split, metrics..., overfitting_gap) of the linear baseline and a forest.

    `forest` adds to the 100 trees of open depth, e.g. {"max_depth": 8} where time is short.
    """
    profile = profile or Profile(df, target, key)
    problem = profile.target_type
    numeric, categorical = routed_columns(profile)
    numeric = [c for c in numeric if c != key]
    categorical = [c for c in categorical if c != key]
    parts = split(profile.df, [key], target if problem == "classification" else None).persist()
    train = parts.where("split = 'train'")
    prep = fit_prep(train, numeric, categorical)
    linear = "LogisticRegression" if problem == "classification" else "LinearRegression"
    predictions = None
    for model, hparams in ((linear, {}), ("RandomForest", {"n_estimators": 100, **(forest or {})})):
        fitted = fit_model(train, target, problem, model, hparams, prep=prep)
        rows = scored(fitted, parts)
        predictions = rows if predictions is None else predictions.unionByName(rows)
    table = M.metrics(predictions, problem, by=("model", "split")).persist()
    out = table.join(M.overfitting_gap(table, problem), "model")
    result = small_table(df.sparkSession, out.collect(), out.schema)  # four metric rows
    table.unpersist()
    parts.unpersist()
    return result


def train_final(df: DataFrame, target: str, key: str, model: str, hparams: dict | None = None,
                profile: Profile | None = None) -> tuple[FittedModel, DataFrame]:
    """Fit on the train part; returns the model and its (model, split, metrics...) table."""
    profile = profile or Profile(df, target, key)
    numeric, categorical = routed_columns(profile)
    parts = scrub_nonfinite(df) if "split" in df.columns else split(
        profile.df, [key], target if profile.target_type == "classification" else None)
    parts = parts.persist()
    skip = (key, "split")
    fitted = fit_model(parts.where("split = 'train'"), target, profile.target_type, model, hparams,
                       [c for c in numeric if c not in skip], [c for c in categorical if c not in skip], key)
    table = M.metrics(scored(fitted, parts), profile.target_type, by=("model", "split"))
    result = small_table(df.sparkSession, table.collect(), table.schema)  # two metric rows
    if model != "KNN":  # a kNN model keeps reading its training rows
        parts.unpersist()
    return fitted, result


def top_importances(importances: DataFrame, k: int = 10) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(k)
