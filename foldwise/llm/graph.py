"""Connected components of links between long ids."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import min_labels
from foldwise.operators.state import skew_join, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, least id) that join the same ids as the links (a[i], b[i]) do, one for each id but the least of its group."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = min_labels(len(ids), at[: len(a)], at[len(a) :])
    other = np.flatnonzero(label != np.arange(len(ids)))
    return ids[other], ids[label[other]]


def forests(links: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """All links (a[i], b[i]) of a task as one forest of stars, in batches."""
    a, b = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for x, y in links:
        a, b = forest(np.concatenate([a, x]), np.concatenate([b, y]))
    for lo in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[lo : lo + 100_000]), pa.array(b[lo : lo + 100_000])], names=["a", "b"])


def shrink(links: DataFrame) -> DataFrame:
    """Replace the links (a, b) of each partition by a forest of stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from forests((batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches)

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def connected_components(links: DataFrame, shrunk: bool = False) -> DataFrame:
    """(id, root) for every id in `links` (a, b): root is the least id that the links lead to.

    Large stars and small stars in turn, each round written to the checkpoint folder, until no link changes; the rounds
    grow with the logarithm of the ids. Links are reduced within partitions first, unless they are `shrunk` already, so that no
    stage runs two Python workers a task; a hub's links are split by adaptive joins. Links of an id with itself and repeated links do no harm; nulls are left out; no links give no rows.
    """
    links = links.where("a is not null and b is not null and a <> b")
    now = written((links if shrunk else shrink(links)).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    was = state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = skew_join(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = skew_join(large, least, ["u"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        if (new := state(now)) == was:
            break
        was = new
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
