import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from tablewright.functions.session import shared_dir, shared_path
from tablewright.operators import models as G
from tablewright.operators.outliers import fit_treatment
from tablewright.sources.readers import read_table
from tablewright.sources.sinks import markdown_lines, save_history, save_report
from tablewright.streaming.rowwise import scored, treated, write_scored


def test_csv_types_and_missing_texts(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,x,s,b,d,allna\n1,1.5,NA,True,2020-01-01,\n2,,"a,""q""",False,2020-01-02,NaN\n3,inf,null,True,x,NA\n4,-2e3,b,False,y,\n',
                    encoding="utf-8")
    df = read_table(spark, str(path))
    assert dict(df.dtypes) == {"id": "bigint", "x": "double", "s": "string", "b": "boolean", "d": "string", "allna": "string"}
    assert [r["x"] for r in df.orderBy("id").collect()] == [1.5, None, None, -2000.0]
    assert [r["s"] for r in df.orderBy("id").collect()] == [None, 'a,"q"', None, "b"]
    assert df.where("allna is not null").count() == 0
    given = read_table(spark, str(path), schema="id int, x double, s string, b boolean, d string, allna string")
    assert given.schema["id"].dataType.simpleString() == "int" and given.count() == 4


def test_json_forms(spark, tmp_path):
    whole, lines = tmp_path / "w.json", tmp_path / "l.jsonl"
    whole.write_text('[{"a": 1, "b": "x"},\n {"a": 2, "b": null}]')
    lines.write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": null}\n')
    want = [(1, "x"), (2, None)]
    assert rows_of(read_table(spark, str(whole)), "a") == want
    assert rows_of(read_table(spark, str(lines)), "a") == want


def test_spreadsheets_are_refused(spark):
    with pytest.raises(ValueError):
        read_table(spark, "/tmp/x.xlsx")


def test_unknown_extension_is_csv(spark, tmp_path):
    path = tmp_path / "t.data"
    path.write_text("a,b\n1,x\n")
    assert rows_of(read_table(spark, str(path))) == [(1, "x")]


def test_history_and_report(spark):
    history = spark.createDataFrame([(0, 0.92, "LinearRegression", 2)], "gen long, best_fitness double, best_model string, num_features long")
    path = save_history(history, shared_path(spark, "r"), "20260215")
    assert path.endswith("ga_report_20260215.json")
    assert rows_of(read_table(spark, path, multi_line=False).select(*history.columns)) == rows_of(history)
    results = spark.createDataFrame([("d", 0.2824, 0.7818, 0.7465, 0.0029, "RandomForest")],
                                    "dataset string, ori double, mu double, fitness double, gap double, model string")
    report = save_report(results, shared_path(spark, "b"))
    assert markdown_lines(report).first()[0] == "| d | 0.282 | 0.7818 | 0.7465 | 0.0029 | RandomForest |"


def test_shared_folder_is_the_configured_one(spark):
    assert shared_path(spark, "x").startswith(shared_dir(spark).rstrip("/"))
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured


def test_streams_reuse_frozen_statistics(spark, tmp_path):
    rows = [(i, float(i % 5), "ab"[i % 2], float(i % 5) * 2) for i in range(60)] + [(60, 500.0, "a", 1.0)]
    batch = spark.createDataFrame(rows, "id long, x double, s string, y double")
    folder = str(tmp_path / "in")
    batch.write.parquet(folder)
    treatment = fit_treatment(batch, "cap", "y", "id")
    fitted = G.fit_model(treatment.apply(batch), "y", "regression", "LinearRegression", numeric=["x"], categorical=["s"])
    stream = spark.readStream.schema(batch.schema).parquet(folder)
    query = write_scored(scored(treated(stream, treatment), fitted), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(60)
    want = fitted.transform(treatment.apply(batch)).select("id", "x", F.round("prediction", 9))
    got = spark.read.parquet(str(tmp_path / "out")).select("id", "x", F.round("prediction", 9))
    assert rows_of(got, "id") == rows_of(want, "id")
