"""The whole run: profile, treat, derive, search, fit, review; and the benchmark over tables."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import DataFrame, functions as F

from tablewright.functions.tables import half_up, small_table
from tablewright.operators.cluster import clustering_input, dbscan_summary, kmeans_sweep, pca_variance
from tablewright.operators.features import derive, drop_features
from tablewright.operators.metrics import primary_scores
from tablewright.operators.models import train_final
from tablewright.operators.outliers import treat_outliers
from tablewright.operators.prep import split
from tablewright.operators.profile import Profile
from tablewright.operators.rules import review
from tablewright.operators.search import Search, Settings, evolve


def catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per dataset: size, suggested target and its confidence."""
    rows, spark = [], None
    for name, df in tables.items():
        spark = df.sparkSession
        profile = Profile(df)
        ranked = profile.scored_targets()
        confidence = min(max(ranked[0][1] / 8, 0.0), 1.0) if ranked else 0.0
        rows.append((name, profile.rows, len(df.columns), ranked[0][0] if ranked else None, confidence))
    return small_table(spark, rows, "dataset string, num_rows long, num_columns long, "
                                    "suggested_target string, confidence double")


def supervised_run(df: DataFrame, target: str, key: str, strategy: str = "cap", proposals: list[dict] = (),
                   drops: list[str] = (), model: str | None = None, size: int = 10, generations: int = 5,
                   search_on: str = "train", iteration: int = 1, settings: Settings | None = None,
                   threads: int = 4) -> dict:
    """One iteration; returns the fitted model, metrics, history, importances and verdict.

    Candidates are searched on the train rows only; search_on='all' uses every row.
    """
    df = treat_outliers(df, strategy, target, key)
    df, derived = derive(df, list(proposals))
    df, dropped = drop_features(df, list(drops), target)
    profile = Profile(df, target, key)
    problem = profile.target_type
    parts = split(profile.df, [key], target if problem == "classification" else None).persist()
    searched = parts.where("split = 'train'") if search_on == "train" else parts
    search = Search(searched.drop("split"), target, key, problem, risk=profile.risk["score"], threads=threads)
    history, candidates = evolve(search, size, generations, model, settings)
    best = candidates.orderBy(F.desc("fitness"), "gen", "cand_id").first()
    search.close()
    fitted, table = train_final(parts, target, key, best["model"], json.loads(best["hparams"]), profile)
    importances = fitted.importances()
    scores = primary_scores(table, problem).withColumn("run_id", F.lit(iteration))
    verdict = review(scores, importances.withColumn("run_id", F.lit(iteration)), F.lit(iteration))
    return {"model": fitted, "metrics": table, "history": history, "candidates": candidates,
            "importances": importances, "review": verdict, "derived": derived, "dropped": dropped,
            "table": parts}


def unsupervised_run(df: DataFrame, key: str, columns: list[str] | None = None, starts: int = 10,
                     eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """(model, silhouette, inertia, num_clusters, noise_points, explained) rows."""
    names = columns or [c for c, k in Profile(df).kinds.items() if k == "numerical" and c != key]
    scaled = clustering_input(df, key, names).persist()
    none = lambda kind: F.lit(None).cast(kind)
    sweep = kmeans_sweep(scaled, names, starts=starts).select(
        "model", "silhouette", "inertia", none("long").alias("num_clusters"),
        none("long").alias("noise_points"), none("double").alias("explained"))
    density = dbscan_summary(scaled, key, names, eps, min_samples).select(
        F.lit("DBSCAN").alias("model"), "silhouette", none("double").alias("inertia"), "num_clusters",
        "noise_points", none("double").alias("explained"))
    variance = pca_variance(scaled, names).select(
        F.concat(F.lit("PCA "), F.col("component").cast("string")).alias("model"),
        none("double").alias("silhouette"), none("double").alias("inertia"),
        none("long").alias("num_clusters"), none("long").alias("noise_points"),
        F.col("explained"))
    out = sweep.unionByName(density).unionByName(variance)
    scaled.unpersist()
    return out


def benchmark(tables: dict[str, tuple[DataFrame, str, str]], size: int = 5, generations: int = 2,
              model: str = "RandomForest", settings: Settings | None = None, threads: int = 4) -> DataFrame:
    """(dataset, ori, mu, sigma, fitness, gap, model, error) per (table, target, key).

    A table that cannot be searched keeps its row, with the reason; failures of jobs rise.
    """
    rows, spark = [], None
    for name, (df, target, key) in tables.items():
        spark = df.sparkSession
        try:
            profile = Profile(df, target, key)
            search = Search(profile.df, target, key, profile.target_type, risk=profile.risk["score"],
                            threads=threads)
            _, candidates = evolve(search, size, generations, model, settings)
            best = candidates.orderBy(F.desc("fitness"), "gen", "cand_id").first()
            search.close()
            rows.append((name, half_up(profile.risk["score"], 4), best["mu"], best["sigma"],
                         best["fitness"], best["gap"], best["model"], None))
        except (AnalysisException, IllegalArgumentException, ValueError) as error:
            rows.append((name, *[None] * 6, str(error)))
    return small_table(spark, rows, "dataset string, ori double, mu double, sigma double, "
                                    "fitness double, gap double, model string, error string")
