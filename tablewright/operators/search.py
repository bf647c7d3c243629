"""Model, hyper-parameter and feature-subset search with a risk-scaled fitness."""

from __future__ import annotations

import json
import random
import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.functions.columns import as_double, families, ref
from tablewright.functions.session import spread
from tablewright.functions.tables import half_up, small_table
from tablewright.operators import metrics as M
from tablewright.operators import forest as T
from tablewright.operators import linear_pass as P
from tablewright.operators.models import KnnModel, index_labels, make_estimator, tree_rules
from tablewright.operators.prep import fit_numeric, folds, split
from tablewright.operators.svm import FourierFeatures, fit_svr, kernel_scale

# Fitness weights.
FOLDS = 5
RISK_SCALE = 1.5
COMPLEXITY_WEIGHT, SPREAD_WEIGHT, GAP_WEIGHT = 0.05, 0.15, 0.10
DEFAULT_RISK = 0.5
FAILED = -1.0

# What a candidate may be; a two-number tuple is a range, a list a choice.
SPACES = {
    "RandomForest": {"n_estimators": [50, 100, 150, 200, 250], "max_depth": [None, 2, 5, 7, 10, 15, 20],
                     "min_samples_split": (2, 10), "min_samples_leaf": (1, 5),
                     "max_features": ["sqrt", "log2", 0.3, 0.5, 0.7]},
    "LogisticRegression": {"C": (0.01, 10.0), "max_iter": [1000]},
    "LinearRegression": {},
    "SVM": {"C": (0.1, 10.0), "kernel": ["rbf", "linear", "poly"]},
    "DecisionTree": {"max_depth": [None, 3, 5, 10, 15, 20], "min_samples_split": (2, 10)},
    "KNN": {"n_neighbors": [3, 5, 7, 9, 11, 15]},
    "GradientBoosting": {"n_estimators": [50, 100, 150, 200], "learning_rate": [0.01, 0.05, 0.1, 0.2],
                         "max_depth": [3, 5, 7]},
}
SPACES_V0 = {
    "RandomForest": {"n_estimators": (10, 200), "max_depth": [None, 5, 10, 20], "min_samples_split": (2, 10)},
    "LogisticRegression": {"C": (0.01, 10.0)},
    "LinearRegression": {},
}


@dataclass(frozen=True)
class Settings:
    """Search rules; the defaults are the current ones, `v0()` the older ones."""
    spaces: dict = field(default_factory=lambda: SPACES)
    elite_share: float | None = 0.10
    elite: int = 1
    tournament: int | None = None
    flip_rate: float = 0.15
    change_rate: float = 0.20
    tree_step: int = 30
    redraw_depth: bool = True

    @staticmethod
    def v0() -> "Settings":
        return Settings(SPACES_V0, None, 2, 3, 0.10, 0.20, 20, False)

    def elite_count(self, size: int) -> int:
        return self.elite if self.elite_share is None else max(1, int(size * self.elite_share))

    def contestants(self, size: int) -> int:
        wanted = self.tournament or max(2, min(3, size // 5))
        return min(wanted, size)


@dataclass(frozen=True)
class Scoring:
    """How a candidate is judged: `parts` of rows held out in turn, and with `whole` a fit on all rows for the gap.

    `current` takes stratified folds and weighs mean, spread, gap and complexity; `v0` holds the last fifth of the rows in
    hash order out once and adds a tenth of the share of features left out; a failure scores 0 there.
    """
    parts: int = FOLDS
    whole: bool = True
    failed: float = FAILED
    older: bool = False

    @staticmethod
    def v0() -> "Scoring":
        return Scoring(1, False, 0.0, True)

    def marked(self, df: DataFrame, key: str, problem: str) -> DataFrame:
        """Adds `fold`: the part that holds a row out; a number beyond the parts for rows that only train."""
        if self.older:
            return split(df, [key]).withColumn("fold", (F.col("split") != "test").cast("int")).drop("split")
        return folds(df, [key], "label" if problem == "classification" else None, self.parts)


# Operators on candidate, fold and history tables.

def cross_validated(predictions: DataFrame, problem: str, by=("model",)) -> DataFrame:
    """Mean and population std of the fold scores, from one table with a `fold` column."""
    score = "accuracy" if problem == "classification" else "r2"
    per_fold = M.metrics(predictions, problem, by=(*by, "fold"), digits=None)
    return per_fold.groupBy(*by).agg(F.avg(score).alias("mu"), F.stddev_pop(score).alias("sigma"))


def generalisation_gap(train_score: Column, mu: Column) -> Column:
    """Train score (round 4) above the cross-validated mean, never below 0."""
    return F.greatest(F.lit(0.0), F.round(train_score, 4) - mu)


def complexity(candidates: DataFrame) -> Column:
    """0.4 x share of features + 0.6 x size of the model; a NULL depth counts as 20."""
    depth = F.greatest(F.lit(2), F.coalesce("max_depth", F.lit(20))) / F.lit(20.0)
    trees = F.col("n_estimators") / F.lit(250.0)
    model = F.col("model")
    size = (F.when(model.isin("RandomForest", "GradientBoosting"), trees * 0.5 + depth * 0.5)
            .when(model == "DecisionTree", depth).otherwise(0.0))
    return 0.4 * (F.col("n_selected") / F.col("n_features")) + 0.6 * size


def fitness(candidates: DataFrame, risk: float = DEFAULT_RISK) -> DataFrame:
    """Adds complexity and fitness; a candidate without scores gets -1."""
    scale = 1 + RISK_SCALE * risk
    scored = candidates.withColumn("complexity", complexity(candidates))
    value = (F.col("mu") - F.lit(COMPLEXITY_WEIGHT * scale) * F.col("complexity")
             - F.lit(SPREAD_WEIGHT * scale) * F.col("sigma") - F.lit(GAP_WEIGHT * scale) * F.col("gap"))
    return scored.withColumn("fitness", F.coalesce(value, F.lit(FAILED)))


def fitness_v0(candidates: DataFrame) -> DataFrame:
    """Older fitness: score plus a tenth of the share of features left out; failure is 0."""
    value = F.col("score") + 0.1 * (1 - F.col("n_selected") / F.col("n_features"))
    return candidates.withColumn("fitness", F.coalesce(value, F.lit(0.0)))


def generation_summary(candidates: DataFrame, by=("gen",), order: str = "cand_id",
                       keep=("model", "n_selected")) -> DataFrame:
    """Best and mean fitness per generation and what the best candidate is."""
    first = F.min(F.struct((-F.col("fitness")).alias("neg"), F.col(order), *keep)).alias("b")
    return (candidates.groupBy(*by).agg(F.round(F.max("fitness"), 4).alias("best_fitness"),
                                        F.round(F.avg("fitness"), 4).alias("avg_fitness"), first)
            .select(*by, "best_fitness", "avg_fitness", *[F.col(f"b.{c}").alias(f"best_{c}") for c in keep]))


def best_candidate(candidates: DataFrame, by=(), order: str = "cand_id", keep=("model",)) -> DataFrame:
    """The evaluated candidate with the highest fitness, the first one on a tie."""
    first = F.min(F.struct((-F.col("fitness")).alias("neg"), F.col(order), *keep)).alias("b")
    return (candidates.where(F.col("fitness").isNotNull()).groupBy(*by).agg(first)
            .select(*by, f"b.{order}", *[f"b.{c}" for c in keep], (-F.col("b.neg")).alias("fitness")))


def plateaus(history: DataFrame, run: str, gen: str = "gen", tolerance: float = 1e-4) -> DataFrame:
    """Adds `plateau`: from the fourth generation on, best fitness unchanged."""
    before = F.lag("best_fitness").over(Window.partitionBy(run).orderBy(gen))
    flat = (F.abs(F.col("best_fitness") - before) < tolerance) & (F.col(gen) > 3)
    return history.withColumn("plateau", F.coalesce(flat, F.lit(False)))


def run_summary(history: DataFrame, by=("run",), gen: str = "gen") -> DataFrame:
    """Number of generations, last best fitness and its model."""
    last = F.max(F.struct(F.col(gen), "best_fitness", "best_model")).alias("l")
    return (history.groupBy(*by).agg(F.count("*").alias("generations"), last)
            .select(*by, "generations", F.round("l.best_fitness", 4).alias("best_final_fitness"),
                    F.col("l.best_model").alias("top_model")))


# The search itself.

@dataclass
class Candidate:
    model: str
    hparams: dict
    mask: list[int]
    scores: dict | None = None

    def identity(self) -> str:
        return json.dumps([self.model, self.hparams, self.mask], sort_keys=True)

    @property
    def fitness(self) -> float:
        return self.scores["fitness"] if self.scores else FAILED


class Proposer:
    """Seeded source of candidates; a few rows held by the caller."""

    def __init__(self, problem: str, features: int, model: str | None, settings: Settings, seed: int):
        self.problem, self.features, self.model = problem, features, model
        self.settings, self.draw = settings, random.Random(seed)

    def _value(self, options):
        if isinstance(options, list):
            return self.draw.choice(options)
        low, high = options
        return self.draw.randint(low, high) if isinstance(low, int) else self.draw.uniform(low, high)

    def _whole(self, mask: list[int]) -> list[int]:
        if not any(mask):
            mask[self.draw.randrange(self.features)] = 1
        return mask

    def fresh(self) -> Candidate:
        linear = "LogisticRegression" if self.problem == "classification" else "LinearRegression"
        model = self.model or self.draw.choice(["RandomForest", linear])
        hparams = {name: self._value(o) for name, o in self.settings.spaces[model].items()}
        return Candidate(model, hparams, self._whole([self.draw.randint(0, 1) for _ in range(self.features)]))

    def _parent(self, population: list[Candidate]) -> Candidate:
        drawn = self.draw.sample(population, self.settings.contestants(len(population)))
        return max(drawn, key=lambda c: c.fitness)

    def _mutated(self, child: Candidate) -> Candidate:
        s, draw = self.settings, self.draw
        child.mask = self._whole([1 - bit if draw.random() < s.flip_rate else bit for bit in child.mask])
        if child.model == "RandomForest":
            if draw.random() < s.change_rate:
                step = draw.randint(-s.tree_step, s.tree_step)
                child.hparams["n_estimators"] = max(10, child.hparams["n_estimators"] + step)
            if s.redraw_depth and draw.random() < s.change_rate:
                child.hparams["max_depth"] = self._value(s.spaces["RandomForest"]["max_depth"])
        elif child.model == "LogisticRegression" and draw.random() < s.change_rate:
            child.hparams["C"] = max(0.001, child.hparams["C"] * draw.uniform(0.5, 1.5))
        return child

    def next_generation(self, ranked: list[Candidate]) -> list[Candidate]:
        out = ranked[:self.settings.elite_count(len(ranked))]
        while len(out) < len(ranked):
            a, b = self._parent(ranked), self._parent(ranked)
            cut = self.draw.randrange(self.features)
            for one, two in ((a, b), (b, a)):
                child = Candidate(one.model, dict(one.hparams), one.mask[:cut] + two.mask[cut:])
                out.append(self._mutated(child))
        return out[:len(ranked)]


class Search:
    """Evaluates candidates as Spark jobs over one cached table with folds.

    Only numeric and boolean features take part. Fold statistics for filling and scaling
    are computed once per fold and shared by every candidate; scores are remembered.
    """

    def __init__(self, df: DataFrame, target: str, key: str, problem: str, features: list[str] | None = None,
                 risk: float = DEFAULT_RISK, threads: int = 4, scoring: Scoring = Scoring()):
        kinds = families(df)
        self.features = features or [c for c in df.columns if c not in (target, key)]
        self.usable = [c for c in self.features if kinds[c] in ("numeric", "boolean")]
        self.problem, self.risk, self.threads, self.key = problem, risk, threads, key
        self.scoring, self.k = scoring, scoring.parts
        self.spark = df.sparkSession
        value = lambda c: as_double(df, c) if kinds[c] == "numeric" else ref(c).cast("double")
        slim = df.where(ref(target).isNotNull()).select(
            ref(key).alias(key), ref(target).alias("_y"), *[value(c).alias(c) for c in self.usable])
        self.classes = 0
        if problem == "classification":
            slim, labels = index_labels(slim, "_y")
            self.classes = len(labels)
        else:
            slim = slim.withColumn("label", F.col("_y").cast("double"))
        self.table = spread(scoring.marked(slim.drop("_y"), key, problem), key).persist()
        self.rows = self.table.count()
        self.parts = [(self.table.where(F.col("fold") != f), self.table.where(F.col("fold") == f))
                      for f in range(self.k)] + [(self.table, self.table)] * scoring.whole
        self.sizes = [train.count() for train, _ in self.parts]
        self.preps = [fit_numeric(train, self.usable) for train, _ in self.parts]
        self.memo: dict[str, dict | None] = {}
        self.grams: np.ndarray | None = None

    def close(self) -> None:
        self.table.unpersist()

    def _vectors(self, part: DataFrame, prep, chosen: list[str]) -> DataFrame:
        scaled = part.select(self.key, "label", "fold",
                             *[prep.scaled(part, c).alias(f"s{i}") for i, c in enumerate(chosen)])
        names = [f"s{i}" for i in range(len(chosen))]
        return VectorAssembler(inputCols=names, outputCol="features").transform(scaled).drop(*names)

    def _fit(self, candidate: Candidate, train: DataFrame, rows: int):
        kernel = candidate.hparams.get("kernel", "linear")
        if candidate.model == "KNN":
            return KnnModel(train, self.key, self.problem, candidate.hparams.get("n_neighbors", 5)).transform
        expand = None
        if candidate.model == "SVM" and kernel == "rbf":
            expand = FourierFeatures(sum(candidate.mask), kernel_scale(train)).transform
        elif candidate.model == "SVM" and kernel == "poly":
            expand = PolynomialExpansion(degree=3, inputCol="features", outputCol="expanded").transform
        widen = (lambda t: expand(t).withColumn("features", F.col("expanded")).drop("expanded")) \
            if expand else (lambda t: t)
        if candidate.model == "SVM" and self.problem == "regression":
            fitted = fit_svr(widen(train), candidate.hparams.get("C", 1.0))
        else:
            fitted = make_estimator(candidate.model, self.problem, candidate.hparams, rows, self.classes, self.key).fit(widen(train))
        return lambda t: fitted.transform(widen(t))

    def _tree_predictions(self, candidate: Candidate, chosen: list[str]) -> DataFrame:
        """Held-out predictions of the trees of all folds, grown in one job; the last part fits and scores all rows."""
        rules = tree_rules(candidate.model, self.problem, candidate.hparams, self.classes)
        filled = F.array(*[F.struct(F.lit(p).alias("part"), F.array(*[prep.scaled(self.table, c).cast("double") for c in chosen]).alias("x"))
                           for p, prep in enumerate(self.preps)])
        rows = self.table.select(F.xxhash64(self.key).alias("id"), "label", "fold", F.explode(filled).alias("of"))
        last = F.col("of.part") == self.k
        rows = rows.select("of.part", "id", "of.x", F.col("label").cast("double").alias("label"),
                           (last | (F.col("fold") != F.col("of.part"))).alias("trained"), (last | (F.col("fold") == F.col("of.part"))).alias("held"))
        votes = T.fold_votes(rows, rules, len(self.parts))
        return votes.select(F.col("part").alias("fold"), "label", T.decided(F.col("votes"), rules).alias("pred"))

    def _chosen(self, candidate: Candidate) -> list[str]:
        return [c for c, bit in zip(self.features, candidate.mask) if bit and c in self.usable]

    def _least_squares(self, chosen: list[str]) -> list[float | None]:
        """R2 by part from the sums of products of one pass, which all candidates share."""
        if self.grams is None:
            center = self.table.agg(F.avg("label")).first()[0] or 0.0
            self.grams = P.fold_grams(self.table, P.Prepared.of(self.preps, self.usable), self.k, center)
        places, out = [self.usable.index(c) for c in chosen], []
        for part, grams in enumerate(self.grams):
            all_rows = grams.sum(axis=0)
            held = grams[part] if part < self.k else all_rows
            out.append(P.least_squares_r2(all_rows - grams[part] if part < self.k else all_rows, held, places))
        return out

    def evaluate(self, candidate: Candidate) -> dict | None:
        """mu, sigma, gap, complexity and fitness; None when it cannot be fitted."""
        chosen = self._chosen(candidate)
        if not chosen:
            return None
        if candidate.model == "LinearRegression" and self.problem == "regression":
            return self._judged(candidate, self._least_squares(chosen))
        if candidate.model == "LogisticRegression" and self.problem == "classification":
            return self._logistic([candidate])[0]
        predictions = None
        if candidate.model in ("RandomForest", "DecisionTree") and T.fits_task(self.rows, len(chosen)):
            predictions = self._tree_predictions(candidate, chosen)
        else:
            for fold, ((train, held_out), prep) in enumerate(zip(self.parts, self.preps)):
                predict = self._fit(candidate, self._vectors(train, prep, chosen), self.sizes[fold])
                rows = predict(self._vectors(held_out, prep, chosen)).select(
                    F.lit(fold).alias("fold"), "label", F.col("prediction").alias("pred"))
                predictions = rows if predictions is None else predictions.unionByName(rows)
        score = "accuracy" if self.problem == "classification" else "r2"
        per_part = {r["fold"]: r[score] for r in
                    M.metrics(predictions, self.problem, by=("fold",), digits=None).collect()}
        return self._judged(candidate, [per_part.get(p) for p in range(len(self.parts))])

    def _logistic(self, candidates: list[Candidate]) -> list[dict | None]:
        """Scores of logistic candidates, which take their Newton steps in the same passes."""
        wanted = [([self.usable.index(c) for c in self._chosen(x)], x.hparams.get("C", 1.0)) for x in candidates]
        fitted = iter(P.logistic_accuracy(self.table, P.Prepared.of(self.preps, self.usable), self.k, [w for w in wanted if w[0]], self.classes, self.sizes)
                      if any(w[0] for w in wanted) else [])
        return [self._judged(x, next(fitted)) if w[0] else None for x, w in zip(candidates, wanted)]

    def _judged(self, candidate: Candidate, values: list[float | None]) -> dict | None:
        """A candidate's row from its scores by part."""
        if any(v is None for v in values):
            return None
        held = values[:self.k]
        mu = sum(held) / self.k
        row = {"model": candidate.model, "n_estimators": candidate.hparams.get("n_estimators", 100),
               "max_depth": candidate.hparams.get("max_depth", 10), "n_selected": sum(candidate.mask),
               "n_features": len(self.features), "mu": mu, "sigma": (sum((v - mu) ** 2 for v in held) / self.k) ** 0.5,
               "gap": max(0.0, half_up(values[self.k], 4) - mu) if self.scoring.whole else None}
        if self.scoring.older:
            table = small_table(self.spark, [(mu, row["n_selected"], row["n_features"])], "score double, n_selected int, n_features int")
            return {"mu": mu, "sigma": None, "gap": None, "complexity": None, "fitness": fitness_v0(table).first()["fitness"]}
        table = small_table(self.spark, [tuple(row.values())],
                            "model string, n_estimators int, max_depth int, n_selected int, "
                            "n_features int, mu double, sigma double, gap double")
        got = fitness(table, self.risk).first()
        return {c: got[c] for c in ("mu", "sigma", "gap", "complexity", "fitness")}

    def _attempt(self, candidate: Candidate) -> dict | None:
        try:
            return self.evaluate(candidate)
        except (AnalysisException, IllegalArgumentException, ValueError) as error:  # cannot be fitted: scores -1
            warnings.warn(f"{candidate.model} {candidate.hparams} failed: {error}", stacklevel=2)
            return None

    def score_all(self, population: list[Candidate]) -> None:
        unseen = {c.identity(): c for c in population if c.identity() not in self.memo}
        together = {i: c for i, c in unseen.items() if c.model == "LogisticRegression" and self.problem == "classification"}
        if together:
            self.memo.update(zip(together, self._logistic(list(together.values()))))
        alone = {i: c for i, c in unseen.items() if i not in together}
        linear = [c for c in alone.values() if c.model == "LinearRegression" and self._chosen(c)]
        if linear and self.problem == "regression":
            self._least_squares(self._chosen(linear[0]))  # the shared pass, before threads need it
        with ThreadPoolExecutor(self.threads) as pool:
            self.memo.update(zip(alone, pool.map(self._attempt, alone.values())))
        for c in population:
            c.scores = self.memo[c.identity()] or {"mu": None, "sigma": None, "gap": None,
                                                   "complexity": None, "fitness": self.scoring.failed}


def evolve(search: Search, size: int = 10, generations: int = 5, model: str | None = None,
           settings: Settings | None = None, seed: int = 42, patience: int | None = None,
           on_generation=None) -> tuple[DataFrame, DataFrame]:
    """(history, candidates): one row per generation, one per evaluated candidate.

    The best candidate is taken among evaluated ones. `patience` stops after that many
    generations without a better best.
    """
    settings = settings or Settings()
    proposer = Proposer(search.problem, len(search.features), model, settings, seed)
    population = [proposer.fresh() for _ in range(size)]
    log, summaries, stale = [], [], 0
    for gen in range(1, generations + 1):
        search.score_all(population)
        population.sort(key=lambda c: -c.fitness)
        log += [(gen, i, c.model, json.dumps(c.hparams, sort_keys=True), c.mask, sum(c.mask),
                 c.scores["mu"], c.scores["sigma"], c.scores["gap"], c.scores["complexity"], c.fitness)
                for i, c in enumerate(population)]
        best = population[0]
        mean = sum(c.fitness for c in population) / size
        summaries.append((gen, half_up(best.fitness, 4), half_up(mean, 4), best.model, sum(best.mask),
                          json.dumps(best.hparams, sort_keys=True)))
        if on_generation:
            on_generation(summaries[-1])
        stale = stale + 1 if gen > 1 and summaries[-1][1] - summaries[-2][1] < 1e-4 else 0
        if patience is not None and stale >= patience:
            break
        population = proposer.next_generation(population)
    history = small_table(search.spark, summaries,
                          "gen int, best_fitness double, avg_fitness double, best_model string, "
                          "num_features int, best_hparams string")
    candidates = small_table(search.spark, log,
                             "gen int, cand_id int, model string, hparams string, mask array<int>, "
                             "n_selected int, mu double, sigma double, gap double, complexity double, "
                             "fitness double")
    return history, candidates
