"""Embedding near-duplicates by randomised-rotation binary codes.

Each unit vector is turned by a seeded random rotation; the signs of its coordinates are its code, and the code's inner
product with the vector is stored as correction factor. The inner product of a code with another turned vector, divided by
the factor, is an unbiased estimate of the cosine; its error shrinks with the dimension. Codes, factors and the turned
coordinates, rounded to 8 bits, are made once and stored; they alone are dealt to the bands. Vectors are fetched only for
pairs whose estimate lies within the confidence bound of the threshold, or above, and computed exactly, in double precision.

Pairs to estimate come from banded signs of further rotations: enough bands that a pair at the threshold shares one with
probability RECALL, whatever the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import table
from foldwise.llm.graph import connected_components, forest
from foldwise.operators.state import skew_join, written

THRESHOLD, RECALL, SEED = 0.95, 0.999, 17
#: Standard errors within which an estimate must come; vectors of a band value on average; rows of a block of a large band value; exact pairs at a time.
BOUND, BUCKET, BLOCK, EXACT = 4.5, 512, 2048, 50_000


def rotation(d: int, number: int, seed: int = SEED) -> np.ndarray:
    """A seeded random orthogonal matrix; number 0 makes the codes, the others the bands."""
    q, r = np.linalg.qr(np.random.default_rng([seed, d, number]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def bands(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bands and bits of a band for n vectors: values of about BUCKET random vectors, bands enough for the recall."""
    bits = min(24, max(2, round(math.log2(max(1, n) / BUCKET)) if n > BUCKET else 2))
    alike = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - alike)), bits


def scaled(x: np.ndarray) -> np.ndarray:
    """The rows of x times powers of two, which change no angle, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def band_keys(x: np.ndarray, count: int, bits: int, seed: int = SEED) -> np.ndarray:
    """Band values of the rows of x: signs of further rotations' coordinates, `bits` to a band."""
    d = x.shape[1]
    z = np.hstack([x @ rotation(d, 1 + k, seed) for k in range(math.ceil(count * bits / d))])[:, : count * bits] > 0
    return z.reshape(len(x), count, bits).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def codes(x: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What is stored of each row of x: code (packed signs of the turned unit vector), its coordinates in steps of 8 bits, the factor and the step."""
    d = x.shape[1]
    z = unit(x) @ rotation(d, 0, seed)
    step = (np.abs(z).max(axis=1) / 127).astype(np.float32)
    rounded = np.clip(np.rint(z / step[:, None]), -127, 127).astype(np.int8)
    return np.packbits(z > 0, axis=1), rounded, (np.abs(z).sum(axis=1) / math.sqrt(d)).astype(np.float32), step


def estimated(code: np.ndarray, rounded: np.ndarray, factor: np.ndarray, step: np.ndarray, threshold: float = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j, some at a time, whose estimated cosine comes within the confidence bound of the threshold.

    The estimate is the code of j times the rounded coordinates of i, over the factor of j; the bound counts the code's error and the rounding's.
    """
    n, d = rounded.shape
    sign = (np.unpackbits(code, axis=1, count=d).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(d))
    f = factor.astype(np.float64)
    error = np.sqrt(np.maximum(0, 1 - f**2)) / f * math.sqrt(1 - threshold**2) / math.sqrt(max(1, d - 1))
    least = ((threshold - BOUND * error) * f - 1e-4).astype(np.float32)  # the estimate times the factor must reach this
    slack = np.float32(BOUND / math.sqrt(12)) * step
    for lo in range(0, n, 512):
        some = slice(lo, lo + 512)
        near = (rounded[some].astype(np.float32) @ sign.T) * step[some, None] + slack[some, None] >= least
        i, j = np.nonzero(near)
        i += lo
        yield i[i < j], j[i < j]


def packed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes as binary values."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(rows))])


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of `group`, which come one after the other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        g = batch.column("group").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)] if len(g) else []
        for lo, hi in zip(cuts, cuts[1:]):
            if held and held[0].column("group")[0].as_py() != g[lo]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def fresh_pairs(rows: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The estimated pairs of a group that no earlier band and no other block of this band holds."""
    n, t = len(rows), rows["t"][0].as_py()
    own, inner, factor, step = (rows[c].to_numpy() for c in ("own", "inner", "factor", "step"))
    code, rounded = (np.frombuffer(b"".join(rows[c].to_pylist()), dtype=kind).reshape(n, -1) for c, kind in (("code", np.uint8), ("rounded", np.int8)))
    keys = rows["earlier"].combine_chunks().flatten().to_numpy().reshape(n, t)
    for a, b in estimated(code, rounded, factor, step, threshold):
        some = (own[a] != own[b]) | inner[a]
        a, b = a[some], b[some]
        for lo in range(0, len(a), EXACT):
            x, y = a[lo : lo + EXACT], b[lo : lo + EXACT]
            new = ~(keys[x] == keys[y]).any(axis=1)
            yield x[new], y[new]


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Links of every vector of `df`: `key`, n_links, component_id, kept.

    n_links: other rows with cosine >= threshold, in double precision; none below it is counted. component_id: the least
    `key` that links lead to. Vectors that are null, zero or hold null or non-finite components link with nothing, nor do
    those with a null key; vectors of different length never link. A repeated row counts as another vector. Other columns
    are not read; an empty table gives no rows; rows of one key with different vectors share their links. Equal vectors are one vertex with a count, so that copies are never compared.
    """
    kind = "array<float>" if df.select(F.col(vector).alias("x")).schema["x"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast(kind).alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.coalesce(F.col("id").isNotNull() & finite & F.exists("x", lambda v: v != 0), F.lit(False))
    rows = rows.withColumns({"good": good, "h": F.xxhash64("x"), "g": F.xxhash64(F.lit(1), "x")})
    classes = rows.where("good").groupBy("h", "g").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("copies"), F.first("x").alias("x"))
    classes = written(classes)
    count, bits = bands(classes.count(), threshold, recall)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lead", "copies", "d", "code", "rounded", "factor", "step", "keys"]
        for batch in batches:
            xs = batch.column("x")
            sizes, values = np.diff(xs.offsets.to_numpy()), xs.flatten().to_numpy().astype(np.float64)
            first = np.cumsum(sizes) - sizes
            for d in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == d)
                x = values[first[of][:, None] + np.arange(d)]
                code, rounded, factor, step = codes(x)
                keys = band_keys(unit(x), count, bits).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1, dtype=np.int32) * count), pa.array(keys.ravel()))
                columns = [batch.column("lead").take(pa.array(of)), batch.column("copies").take(pa.array(of)), pa.array(np.full(len(of), d, dtype=np.int32)), packed(code), packed(rounded), pa.array(factor), pa.array(step), lists]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    stored = written(classes.select("lead", "copies", "x").mapInArrow(coded, "lead long, copies long, d int, code binary, rounded binary, factor float, step float, keys array<int>"))
    banded = stored.select("*", F.posexplode("keys").alias("t", "k"))
    sizes = written(stored.select("d", F.posexplode("keys").alias("t", "k")).groupBy("d", "t", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK))
    sizes = F.broadcast(sizes) if sizes.count() <= 300_000 else sizes
    blocks = F.ceil(F.coalesce("n", F.lit(1)) / BLOCK).cast("int")
    banded = banded.join(sizes, ["d", "t", "k"], "left").withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("lead"), blocks).cast("int")})
    banded = banded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> own or blocks = 1")
    group = F.xxhash64("d", "t", "k", F.least("own", "other"), F.greatest("own", "other")).alias("group")
    # the pairs within a block count where it meets the next block only
    inner = (F.col("blocks") == 1) | (F.col("other") == (F.col("own") + 1) % F.col("blocks"))
    columns = ["group", "t", "lead", "copies", "own", "inner", "earlier", "code", "rounded", "factor", "step"]
    dealt = banded.select(group, F.slice("keys", 1, F.col("t")).alias("earlier"), inner.alias("inner"), *(c for c in columns if c not in ("group", "earlier", "inner"))).select(*columns)
    dealt = dealt.repartition("group").sortWithinPartitions("group", "lead")

    def surviving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each group that a pair needs whose estimate is near enough: only their vectors are fetched."""
        for rows in groups(batches):
            keep = np.zeros(len(rows), dtype=bool)
            for a, b in fresh_pairs(rows, threshold):
                keep[a] = keep[b] = True
            if keep.any():
                yield from rows.filter(pa.array(keep)).combine_chunks().to_batches()

    schema = "group long, t int, lead long, copies long, own int, inner boolean, earlier array<int>, code binary, rounded binary, factor float, step float"
    survivors = written(dealt.mapInArrow(surviving, schema))
    fetched = skew_join(survivors, classes.select("lead", "x"), ["lead"]).select(*columns, "x").repartition("group").sortWithinPartitions("group", "lead")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches):
            n, lead, copies = len(rows), rows["lead"].to_numpy(), rows["copies"].to_numpy()
            x = scaled(rows["x"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(n, -1))
            norm, links = np.linalg.norm(x, axis=1), np.zeros(n)
            near: list[tuple[np.ndarray, np.ndarray]] = [(lead[:0], lead[:0])]
            for a, b in fresh_pairs(rows, threshold):
                exact = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b]) >= threshold
                a, b = a[exact], b[exact]
                links += np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
                near = [forest(*(np.concatenate(part) for part in zip(*near, (lead[a], lead[b]))))]
            some = np.flatnonzero(links > 0)
            if not len(some):
                continue
            ids, roots = near[0]
            at = np.minimum(np.searchsorted(ids, lead[some]), len(ids) - 1) if len(ids) else np.zeros(len(some), dtype=np.int64)
            root = np.where(ids[at] == lead[some], roots[at], lead[some]) if len(ids) else lead[some]
            yield pa.RecordBatch.from_arrays([pa.array(lead[some]), pa.array(links[some].astype(np.int64)), pa.array(root)], names=["a", "links", "b"])

    found = written(fetched.mapInArrow(compared, "a long, links long, b long"))
    total = found.groupBy(F.col("a").alias("lead")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("a", "b")).withColumnRenamed("id", "lead")
    info = classes.select("h", "g", "lead", "copies").join(total, "lead", "left").join(parts, "lead", "left")
    info = info.select("h", "g", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "lead").alias("component_id"))
    linked = skew_join(rows.where("good").select("id", "h", "g"), info, ["h", "g"]).select("id", "n_links", "component_id")
    alone = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op1_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_rotation_codes": op1_rotation_codes}
