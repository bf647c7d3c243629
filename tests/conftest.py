import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def mixed_frame():
    """Nulls, NaN, infinities, a constant, a boolean, odd names and non-ASCII text."""
    nan, inf = float("nan"), float("inf")
    return pd.DataFrame({
        "id": list(range(1, 11)),
        "a.b": [1.0, 2.0, None, 4.0, nan, 6.0, inf, 8.0, -inf, 100.0],
        "q`x": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10],
        "const": [3.5] * 10,
        "empty": pd.Series([None] * 10, dtype="float64"),
        "flag": [True, False] * 5,
        "naïve": ["ä", "b", "b", None, "ä", "c", "c", "b", "ä", "ß"],
    })


MIXED_SCHEMA = ("id long, `a.b` double, `q``x` int, const double, empty double, flag boolean, `naïve` string")


@pytest.fixture(scope="session")
def mixed(spark, mixed_frame):
    rows = [tuple(None if v is None or (isinstance(v, float) and np.isnan(v) and c == "empty") else v
                  for c, v in zip(mixed_frame.columns, r))
            for r in mixed_frame.astype(object).itertuples(index=False, name=None)]
    return spark.createDataFrame(rows, MIXED_SCHEMA)


@pytest.fixture(scope="session")
def clean_mixed(mixed_frame):
    """The same table as pandas sees it: one missing marker, no infinities."""
    return mixed_frame.replace([np.inf, -np.inf], np.nan)


def rows_of(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
