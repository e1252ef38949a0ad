"""Fill-in-middle: texts cut at two seeded places into prefix, middle and suffix, and put in another order.

Cuts are counted in units, whose beginnings a predicate on two adjacent bytes finds. Each text is decomposed into chunks
that overlap by one byte, so that every chunk can count its units without its neighbours. Prefix sums of the counts route
both cut ranks to the chunks that own them, and only those are scanned again for the places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.common import chunks, flat, table

#: Bytes of a chunk, and of the texts that a task cuts at once.
CHUNK, SLAB = 4096, 8 << 20
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}

#: Whether a unit begins at the byte `here`, by the byte before it (a blank before a text).
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "characters": lambda before, here: (here & 0xC0) != 0x80,
    "words": lambda before, here: _blank(before) & ~_blank(here),
}


def _blank(b: np.ndarray) -> np.ndarray:
    return (b == 0x20) | ((b >= 0x09) & (b <= 0x0D))


@dataclass(frozen=True)
class Chunks:
    """Chunks of all texts of a slab: where each begins, the units before it (one entry more than chunks), each text's first chunk (one more than texts)."""

    begins: np.ndarray
    before: np.ndarray
    first: np.ndarray

    @property
    def units(self) -> np.ndarray:
        return np.diff(self.before[self.first])


def begins(raw: np.ndarray, lo: int, hi: int, heads: np.ndarray, unit: str) -> np.ndarray:
    """The predicate over the bytes lo to hi, which are read with one byte of overlap; `heads`: where texts begin among them."""
    before = np.empty(hi - lo, dtype=np.uint8)
    before[1:] = raw[lo : hi - 1]
    before[:1] = raw[lo - 1] if lo else 0x20
    before[heads - lo] = 0x20
    return UNITS[unit](before, raw[lo:hi])


def decomposed(raw: np.ndarray, ends: np.ndarray, unit: str = "characters", chunk: int = CHUNK) -> Chunks:
    """Count the units of every chunk of the texts raw[ends[k]:ends[k + 1]], and add them up."""
    many = -(-np.diff(ends) // chunk)
    first = np.concatenate([[0], np.cumsum(many)])
    at = np.repeat(ends[:-1], many) + (np.arange(first[-1]) - np.repeat(first[:-1], many)) * chunk
    counts = np.zeros(len(at), dtype=np.int64)
    heads = ends[:-1][many > 0]
    group = max(1, (1 << 20) // chunk)
    for lo in range(0, len(at), group):  # so many chunks at a time
        here = at[lo : lo + group]
        end = int(at[lo + group]) if lo + group < len(at) else len(raw)
        own = heads[np.searchsorted(heads, here[0]) : np.searchsorted(heads, end)]
        counts[lo : lo + group] = np.add.reduceat(begins(raw, int(here[0]), end, own, unit).astype(np.int64), here - here[0])
    return Chunks(at, np.concatenate([[0], np.cumsum(counts)]), first)


def places(raw: np.ndarray, ends: np.ndarray, cut: Chunks, ranks: np.ndarray, unit: str = "characters") -> np.ndarray:
    """For each text the byte where the unit of that rank begins; the text's end for a rank beyond its last unit, its beginning for rank 0."""
    out = np.where(ranks >= cut.units, ends[1:], ends[:-1])
    inside = np.flatnonzero((ranks > 0) & (ranks < cut.units))
    wanted = cut.before[cut.first[inside]] + ranks[inside]
    owner = np.searchsorted(cut.before, wanted, side="right") - 1
    stop = np.append(cut.begins[1:], len(raw))
    for k, c, r in zip(inside.tolist(), owner.tolist(), (wanted - cut.before[owner]).tolist()):
        lo, hi = int(cut.begins[c]), int(stop[c])
        heads = np.array([lo] if lo == ends[k] else [], dtype=np.int64)
        out[k] = lo + np.flatnonzero(begins(raw, lo, hi, heads, unit))[r]
    return out


def fill_in_middle(df: DataFrame, key: str, text: str, seed: int = 1, plain: int = 10, spm: int = 20, unit: str = "characters") -> DataFrame:
    """Every row of `df` as `key`, n (units of the text), form, prefix and middle (units of each, null for plain) and output.

    The four numbers h1 to h4 are the first eight-digit groups of the hex SHA-256 of `<seed>:<key>`. The prefix ends after
    the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger. A text stays plain if it is empty,
    holds a mark or h3 % 100 >= 100 - plain; else it is `spm` (suffix first) if h4 % 100 < spm, or `psm` (prefix first).
    A null text counts as empty, a null key as an empty string; equal rows get equal results; an empty table gives no
    rows; other columns are not read, so names that clash are harmless.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), *h)
    marks = [m.encode() for m in MARKS.values()]
    p, s, m = marks

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, ends = flat(batch.column(1))
        h1, h2, h3, h4 = (c.to_numpy() for c in batch.columns[2:])
        found = decomposed(raw, ends, unit)
        n = found.units
        low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
        one, two = places(raw, ends, found, low, unit), places(raw, ends, found, high, unit)
        forms, outputs = [], []
        for k, (a, x, y, b) in enumerate(zip(ends[:-1].tolist(), one.tolist(), two.tolist(), ends[1:].tolist())):
            whole = raw[a:b].tobytes()
            if a == b or h3[k] % 100 >= 100 - plain or any(mark in whole for mark in marks):
                forms.append("plain")
                outputs.append(whole)
                continue
            prefix, middle, suffix = whole[: x - a], whole[x - a : y - a], whole[y - a :]
            forms.append("spm" if h4[k] % 100 < spm else "psm")
            outputs.append(s + suffix + p + prefix + m + middle if forms[-1] == "spm" else p + prefix + s + suffix + m + middle)
        kept = np.array([f == "plain" for f in forms], dtype=bool)
        columns = [batch.column(0), pa.array(n), pa.array(forms, pa.string()), pa.array(low, mask=kept), pa.array(high - low, mask=kept), pa.array(outputs, pa.binary()).view(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["key", "n", "form", "prefix", "middle", "output"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(np.diff(flat(batch.column(1))[1]), SLAB):
                yield cut(batch.slice(lo, hi - lo))

    kind = rows.schema["key"].dataType
    fields = [("key", kind), ("n", T.LongType()), ("form", T.StringType()), ("prefix", T.LongType()), ("middle", T.LongType()), ("output", T.StringType())]
    out = rows.mapInArrow(run, T.StructType([T.StructField(a, b) for a, b in fields]))
    return out.withColumnRenamed("key", key)


def restored(output: str = "output", form: str = "form") -> F.Column:
    """The text from an output and its form, both columns. No text that was cut holds a mark, so the marks split it into its three parts."""
    parts = F.split(F.col(output), "|".join(MARKS.values()))
    first, second, third = (F.element_at(parts, i) for i in (2, 3, 4))
    return F.when(F.col(form) == "psm", F.concat(first, third, second)).when(F.col(form) == "spm", F.concat(second, third, first)).otherwise(F.col(output))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", "n", "form", F.col("prefix").alias("prefix_chars"), F.col("middle").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}

ORACLE = {
    "op12_fill_in_middle": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS y, substr(t, b + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
}
