"""Registered queries against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from catalog.base import BASE_TABLES

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "feature_types", "numeric_summary_dirty", "correlation_matrix_dirty", "outlier_samples",
    "overfitting_risk_dirty", "target_candidates_dirty_events", "outliers_cap", "derived_columns",
    "null_strategies", "standardise", "split_stratified", "folds_stratified", "csv_missing_texts",
    "class_scores", "regression_metrics", "risk_scaled_fitness", "review_verdicts",
    "reply_validation_strict", "histogram_dirty", "silhouette", "dbscan", "knn_neighbours",
]
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in BASE_TABLES:
        connection.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return float(value) if hasattr(value, "as_tuple") else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    result = duck.execute(entry.oracle_sql()[name])
    want = rows([d[0] for d in result.description], result.fetchall())
    assert rows(df.columns, df.collect()) == want


@pytest.mark.parametrize("wide", [True, False])
def test_flags_of_columns_without_outliers(spark, duck, tmp_path, wide):
    # users far apart leave half_null without outliers; with equal values no column has any
    value = "(event_id % 10)::double" if wide else "0.0::double"
    user = "user_id + event_id * 1000" if wide else "event_id"
    duck.execute(f"""copy (select * replace ({value} as value, ({user})::bigint as user_id) from events)
        to '{tmp_path}/events.parquet' (format parquet)""")
    df = entry.queries()["outliers_flag"](spark, str(tmp_path))
    own = duckdb.connect()
    own.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    result = own.execute(entry.oracle_sql()["outliers_flag"])
    want = rows([d[0] for d in result.description], result.fetchall())
    assert rows(df.columns, df.collect()) == want


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 7
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_learning_queries_use_the_defaults(monkeypatch):
    from catalog import learning
    calls = []

    class Table:
        def __getattr__(self, name):
            return lambda *args, **more: self

        def __getitem__(self, name):
            return self

        def __iter__(self):
            return iter((self, self))

    def note(*args, **more):
        calls.append((args, more))
        return Table()

    for name in ("load", "benchmark", "supervised_run", "unsupervised_run", "leaderboard"):
        monkeypatch.setattr(learning, name, note)
    for module, name in ((learning.G, "baselines"), (learning.G, "train_final"), (learning.H, "Search"), (learning.H, "evolve")):
        monkeypatch.setattr(module, name, note)
    for name in ("baselines_classification", "baselines_regression", "feature_importances", "benchmark_leaderboard", "unsupervised_run",
                 "model_search", "model_search_trees", "model_search_v0", "supervised_run"):
        calls.clear()
        entry.queries()[name](None, FOLDER)
        for args, more in calls:
            assert not {"forest", "size", "generations", "starts"} & set(more), name
            assert not any(isinstance(a, int) for a in args) and not any(isinstance(a, dict) and "max_depth" in a for a in args), name
        assert calls, name
