"""Frozen statistics on a stream: operators that need nothing but the row at hand.

A Treatment, the preprocessing expressions, reply validation and scoring are projections
once their statistics are fitted on a batch table, so the same calls work on a streaming
DataFrame. `write_scored` is the usual end of such a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tablewright.functions.columns import scrub_nonfinite
from tablewright.operators.models import FittedModel
from tablewright.operators.outliers import Treatment


def treated(stream: DataFrame, treatment: Treatment) -> DataFrame:
    """Apply a treatment fitted on a batch table."""
    return treatment.apply(scrub_nonfinite(stream))


def scored(stream: DataFrame, fitted: FittedModel) -> DataFrame:
    """Add predictions of a fitted model."""
    return fitted.transform(scrub_nonfinite(stream))


def write_scored(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet and stop when the input at hand is used up."""
    return (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start(path))
