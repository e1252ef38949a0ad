"""Lineage cuts and global positions that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that removes a query's shuffle files as soon as the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, made from `spark.checkpoint.dir`.

    A temporary one is made only where none is set and the master is local: executors elsewhere couldn't read it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="foldwise-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


def hadoop_paths(spark: SparkSession, *paths: str) -> tuple:
    """The file system of the first path, and all paths, as Spark's own readers and writers see them."""
    found = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return found[0].getFileSystem(spark._jsc.hadoopConfiguration()), tuple(found)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder of the session and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def global_position(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Add the 0-based position of each row in the total order, without moving all rows into one task.

    Rows are range-partitioned and sorted; the driver gets one count for each partition, whose running sum is each
    partition's offset, which is joined back by a broadcast of one row a partition. The sorted rows are checkpointed, as
    range bounds are sampled anew when a plan runs again.
    """
    at = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    total, offsets = 0, []
    for p, n in sorted((r[0], r[1]) for r in at.groupBy(part.alias("p")).count().collect()):
        offsets.append((p, total))
        total += n
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    if len(offsets) < 2:
        return at.withColumn(name, within).drop("_at")
    starts = df.sparkSession.createDataFrame(offsets, "_part long, _start long")
    return at.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + within).drop("_at", "_part", "_start")


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on the columns `on` so that adaptive execution can split a hot key's rows.

    A side that is already partitioned by the key (an aggregate's result) has no exchange of its own, and Spark then leaves
    its partner's hot partitions whole. A second key, derived from the first, makes both sides exchange.
    """
    key = F.xxhash64(*on)
    return left.withColumn("_key", key).join(right.withColumn("_key", key), [*on, "_key"], how).drop("_key")


def written(df: DataFrame) -> DataFrame:
    """Write `df` as a Parquet table in the shared checkpoint folder and read it again: as `checkpoint`, but in columns and compressed.

    The table needs the write's shuffle files no more: the setting CLEANUP removes them at its end, not when the driver next
    collects garbage. Queries of other threads that end meanwhile remove theirs too, and make them anew if they run again.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
