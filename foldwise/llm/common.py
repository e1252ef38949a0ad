"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Java's \s is exactly the complement's character set.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def chunks(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to at most `most`; a larger single item is a range of its own."""
    out, start, total = [], 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > start and total + s > most:
            out.append((start, i))
            start, total = i, 0
        total += s
    if len(sizes) > start:
        out.append((start, len(sizes)))
    return out


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, one after another, and their len + 1 bounds; nothing is copied."""
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component label, the smallest member, of each of n vertices under the edges (a[i], b[i])."""
    label = np.arange(n, dtype=np.int64)
    a, b = np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64)
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:  # pointer jumping until every vertex points at a root
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label
