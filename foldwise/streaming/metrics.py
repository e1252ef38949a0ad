"""Metrics of streams: exact partial sums of every micro-batch, kept by batch id, so that a replayed batch counts once and the final value is the table's."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foldwise.operators.metrics import Metric, exact_parts
from foldwise.sources.rows import DataError


def partials(scored: DataFrame, metric: Metric) -> DataFrame:
    """(term, exponent, high, low): the exact sums of the metric's terms by exponent, and the number of rows under the term `_n`. They merge by adding up, in any order."""
    parts = [exact_parts(scored, c.cast("double")).select(F.lit(k).alias("term"), "exponent", "high", "low") for k, c in metric.terms().items()]
    rows = scored.agg(F.count(F.lit(1)).alias("low")).select(F.lit("_n").alias("term"), F.lit(0).cast("long").alias("exponent"), F.lit(0).cast("long").alias("high"), "low")
    return reduce(lambda a, b: a.unionByName(b), [rows, *parts])


def measure_stream(scored: DataFrame, metric: Metric, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep the partials of each micro-batch of a stream of scored rows (truth, prediction, weight) as `folder`/batch=<id>; stops when it has caught up.

    A batch that is run again after a failure overwrites what it had left, whole or not.
    """

    def keep(batch: DataFrame, number: int) -> None:
        partials(batch, metric).coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return scored.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def value(spark: SparkSession, metric: Metric, folder: str) -> float:
    """The metric over all batches so far; sums are rounded once, at the end."""
    got = spark.read.parquet(folder).groupBy("term", "exponent").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    sums: dict = {k: Fraction(0) for k in metric.terms()} | {"_n": 0}
    for r in got:
        if r["term"] == "_n":
            sums["_n"] = r["low"]
        elif r["exponent"] == 2047:
            raise DataError("NonFinite", r["term"])
        else:
            sums[r["term"]] += Fraction(((r["high"] << 26) + r["low"]) << (r["exponent"] - 1), 1 << 1074)
    if not sums["_n"]:
        raise DataError("Empty", metric.name)
    return metric.finish({k: v if k == "_n" else float(v) for k, v in sums.items()})
