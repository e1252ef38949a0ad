"""Scoring streams. Fitted stages are expressions, so a stream is scored as a table is; no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from foldwise.operators.stages import Fitted


def score_stream(fitted: Fitted, stream: DataFrame) -> DataFrame:
    """The stream's rows with features and prediction. Joins with a serving state are stream-static joins."""
    return fitted.apply(stream)


def score_folder(spark: SparkSession, fitted: Fitted, source: str, sink: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Score each new Parquet file of a folder once, exactly, into another; stops when it has caught up."""
    out = score_stream(fitted, spark.readStream.schema(schema).parquet(source))
    return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
