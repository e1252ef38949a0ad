"""Two-pass external shuffle of a table into shards of equal row counts.

Pass 1 scatters whole records uniformly into memory-sized buckets by a seeded hash. Pass 2 permutes each bucket with a
seeded Fisher-Yates shuffle and writes it. The concatenation of all permuted buckets is a uniform random order of the table;
shard s of S holds positions floor(s*N/S) up to floor((s+1)*N/S), so that counts differ by one at most (law `rows`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.common import table
from foldwise.operators.state import written

#: Bytes of text in a bucket, on average, and the most partitions that the buckets are dealt over.
BUCKET_BYTES, MOST_PARTITIONS = 32 << 20, 20_000
#: Hashes of repeated records, and buckets, are broadcast up to so many, else joined by a shuffle; rows and bytes of text in a batch; copies of a record made at once.
BROADCAST, BATCH_ROWS, BATCH_BYTES, COPIES = 300_000, 4096, 8 << 20, 10_000


def scattered(df: DataFrame, key: str, text: str, seed: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """`df` with size, text_crc32, bucket and _order (place in the bucket before the shuffle); the number of buckets.

    Records are dealt by their hash. Equal ones would all meet in one bucket, so those that occur twice or more are counted,
    and each copy is dealt by its number; the copies are made anew in parts of COPIES.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key), F.col(text)).withColumns({"size": (F.octet_length(body) + 16).cast("long"), "text_crc32": F.crc32(body)})
    rows = rows.withColumn("_at", F.xxhash64(F.lit(seed), F.col(key), F.col(text).isNull(), "text_crc32", "size"))
    seen = written(rows.groupBy("_at").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")))
    buckets = max(1, math.ceil((seen.agg(F.sum("bytes")).first()[0] or 0) / bucket_bytes))
    twice = seen.where("n > 1").select("_at", F.lit(True).alias("_twice"))
    if n := twice.count():
        rows = rows.join(F.broadcast(twice) if n <= BROADCAST else twice, "_at", "left")
        many = rows.where("_twice").groupBy(key, text, "size", "text_crc32", "_at").agg(F.count(F.lit(1)).alias("n"))
        many = many.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))).repartition("_at", "_part")
        copy = F.explode(F.sequence(F.col("_part") * COPIES, F.least((F.col("_part") + 1) * COPIES, "n") - 1))
        many = many.withColumn("_copy", copy).withColumn("_at", F.xxhash64("_at", "_copy"))
        rows = rows.where("_twice is null").drop("_twice").unionByName(many.drop("n", "_part", "_copy"))
    return rows.withColumns({"bucket": F.pmod("_at", F.lit(buckets)).cast("int"), "_order": F.xxhash64(F.lit(seed + 1), "_at")}).drop("_at"), buckets


def external_shuffle(df: DataFrame, key: str, text: str, shards: int = 40, seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of `df` (columns `key` and `text`) with their size, checksum, shard and slot.

    Returns `key`, `text`, size (UTF-8 bytes plus 16), text_crc32, bucket, shard, slot. Other columns of `df` are not
    read, so names that clash are harmless. A null text counts as empty and stays null; null keys are scattered by their
    text; equal rows are interchangeable and are scattered like others; an empty table gives no rows. The permuted buckets
    are a table in the checkpoint folder; their row counts are joined, not collected.
    """
    rows, buckets = scattered(df, key, text, seed, bucket_bytes)
    dealt = rows.repartition(min(buckets, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket", "_order", key, "size", "text_crc32").drop("_order")
    schema = T.StructType([*dealt.schema.fields, T.StructField("place", T.LongType())])

    def permuted(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = pa.Table.from_batches(parts)
        sizes = bucket["size"].to_numpy()
        order = np.arange(len(bucket))
        np.random.default_rng([seed, bucket["bucket"][0].as_py()]).shuffle(order)  # numpy's shuffle is Fisher-Yates
        whole = bucket.combine_chunks()
        ends = np.cumsum(sizes[order])
        lo = 0
        while lo < len(order):
            hi = min(lo + BATCH_ROWS, max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BATCH_BYTES, side="right"))))
            some = whole.take(pa.array(order[lo:hi])).append_column("place", pa.array(np.arange(lo, hi)))
            yield from some.combine_chunks().to_batches()
            lo = hi

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("bucket")).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if held and held[0].column(batch.schema.get_field_index("bucket"))[0].as_py() != ids[lo]:
                    yield from permuted(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from permuted(held)

    placed = written(dealt.mapInArrow(shuffle, schema))
    counts = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))
    n = placed.count()
    # the rows before each bucket, in blocks of buckets so that no window sees them all
    block = F.floor(F.col("bucket") / 1024)
    blocks = {r["b"]: r["n"] for r in counts.groupBy(block.alias("b")).agg(F.sum("_n").alias("n")).collect()}
    before, starts = 0, []
    for b in sorted(blocks):
        starts.append((int(b), before))
        before += blocks[b]
    starts = placed.sparkSession.createDataFrame(starts, "_b long, _start long")
    w = Window.partitionBy("_b").orderBy("bucket")
    first = counts.withColumn("_b", block).join(F.broadcast(starts), "_b").select("bucket", (F.col("_start") + F.sum("_n").over(w) - F.col("_n")).alias("_first"))
    out = placed.join(F.broadcast(first) if buckets <= BROADCAST else first, "bucket")
    position = F.col("_first") + F.col("place")
    out = out.withColumn("_p", position).withColumn("shard", F.expr(f"((_p + 1) * {shards}L - 1) div {max(1, n)}L").cast("int"))
    slot = F.col("_p") - F.expr(f"(cast(shard as bigint) * {n}L) div {shards}L")
    return out.select(key, text, "size", "text_crc32", "bucket", "shard", slot.alias("slot"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write an external shuffle as folders shard=0, shard=1, ..., the rows of each file in slot order."""
    shuffled.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = external_shuffle(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "bucket")


QUERIES = {"op5_external_shuffle": op5_external_shuffle}
