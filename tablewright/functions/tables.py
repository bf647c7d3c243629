"""Small result tables built from a handful of aggregated scalars."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame, SparkSession


def half_up(value, digits: int):
    """Decimal half-up rounding, the same as SQL round; None for NULL and NaN."""
    if value is None or math.isnan(value):
        return None
    step = Decimal(1).scaleb(-digits)
    return float(Decimal(repr(float(value))).quantize(step, ROUND_HALF_UP)) + 0.0  # no -0.0


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """One-partition table of statistics; its size grows with the columns, not the rows."""
    return spark.createDataFrame(rows, schema).coalesce(1)
