"""SimHash near-duplicates by hierarchical indexes over fingerprints in Gray order.

Fingerprints that differ in few bits agree in some of their parts; each choice of agreeing parts is a table whose keys deal
the fingerprints into groups. Within a group the fingerprints are sorted by Gray rank, so that neighbours share bits. Runs
of neighbours form nodes; the bits that all members share are factored into the node's masked pattern, those of its
children that the parent hasn't accounted for into the children's. A search walks down from the root with the differences
so far and drops a whole node as soon as they exceed the limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import min_labels, table
from foldwise.llm.graph import connected_components, forests
from foldwise.operators.state import checkpoint, skew_join

BITS, LIMIT, SHINGLE, SEED = 64, 3, 3, 42
#: Children of a node, fingerprints of a hot group in one block, rows that a task indexes at once, pairs that it holds at once; texts at a time.
FANOUT, BLOCK, ROWS, PAIRS, DOCS = 8, 1024, 65_536, 4_000_000, 500
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the text's word shingles, repeats included, A-Z lower-cased; 0 if it has no word."""
    words = (text or "").encode("utf-8", errors="surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))
    h = np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts), dtype="<u8", count=len(parts))
    ones = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(h), 65_536):
        ones += np.unpackbits(h[lo : lo + 65_536].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, h, fp): the fingerprint of every whole text, as a signed long, and the text's hash; null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, DOCS) for whole in batches for at in range(0, len(whole), DOCS)):
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], names=[key, "h", "fp"])

    return df.select(F.col(key), F.col(text), F.xxhash64(text).alias("h")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, h long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in Gray order."""
    out = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(k)
    return out


def tables(n: int, limit: int = LIMIT) -> list[int]:
    """Masks of agreeing parts: of p parts, `limit` differing bits leave p - limit alike. p is the least that keeps groups of n random codes small."""
    for p in range(limit + 1, 9):
        edges = [round(i * BITS / p) for i in range(p + 1)]
        parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
        masks = [sum(c) for c in combinations(parts, p - limit)]
        if n <= 64 << min(m.bit_count() for m in masks):
            break
    return masks


def linked(group: np.ndarray, codes: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between codes of the same group: positions (i, j). `group` is sorted."""
    order = np.lexsort((gray_rank(codes), group))
    group, codes = group[order], codes[order]
    n = len(codes)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    # levels from the leaves up: AND and OR of the codes below, the group, the first child, the end of the leaves
    level = {"and": codes, "or": codes, "group": group, "end": np.arange(1, n + 1)}
    levels = [level]
    while len(level["group"]) > 1 and (level["group"][1:] == level["group"][:-1]).any():
        g = level["group"]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        within = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
        heads = np.flatnonzero(within % FANOUT == 0)
        tails = np.append(heads[1:], len(g))
        level = {"and": np.bitwise_and.reduceat(level["and"], heads), "or": np.bitwise_or.reduceat(level["or"], heads), "group": g[heads], "end": level["end"][tails - 1], "child": heads, "tail": tails}
        levels.append(level)
    for k, x in enumerate(reversed(levels)):
        mask = ~(x["and"] ^ x["or"])
        x["pattern"], x["rest"] = x["and"] & mask, mask
        if k:  # the bits that the parent has accounted for don't count again
            up = levels[len(levels) - k]
            x["rest"] = mask & ~np.repeat(up["mask"], up["tail"] - up["child"])
        x["mask"] = mask
    root = np.searchsorted(levels[-1]["group"], group)
    a, b = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), n))
    cost = np.cumsum(np.repeat(size, size))  # pairs at most, up to each query
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + PAIRS, side="right")))
        query, node, apart = np.arange(lo, hi), root[lo:hi], np.zeros(hi - lo, dtype=np.uint8)
        for depth in range(len(levels) - 1, 0, -1):
            x, below = levels[depth], levels[depth - 1]
            many = x["tail"][node] - x["child"][node]
            total = np.cumsum(many)
            child = np.repeat(x["child"][node] - (total - many), many) + np.arange(total[-1] if len(total) else 0)
            query, apart = np.repeat(query, many), np.repeat(apart, many)
            later = below["end"][child] > query + 1  # each pair once
            query, child, apart = query[later], child[later], apart[later]
            apart = apart + np.bitwise_count((codes[query] ^ below["pattern"][child]) & below["rest"][child])
            near = apart <= limit
            query, node, apart = query[near], child[near], apart[near]
        later = node > query
        a, b = np.concatenate([a, query[later]]), np.concatenate([b, node[later]])
        label = min_labels(n, a, b)
        a = np.flatnonzero(label != np.arange(n))
        b = label[a]
        lo = hi
    return order[a], order[b]


def links(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Forests (a, b), one a task, that join the distinct fingerprints of `fps` (fp) which differ in at most `limit` bits.

    Groups of over BLOCK fingerprints are split into blocks; every pair of blocks meets in a group of its own.
    """
    n = fps.count()
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in tables(n, limit)])
    rows = fps.select("fp", F.posexplode(masks).alias("t", "m")).select("fp", "t", F.col("fp").bitwiseAND(F.col("m")).alias("k"))
    sizes = checkpoint(rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK))
    blocks = F.ceil(F.coalesce("n", F.lit(1)) / BLOCK).cast("int")
    big = F.broadcast(sizes) if sizes.count() <= 300_000 else sizes
    rows = rows.join(big, ["t", "k"], "left").withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("fp"), blocks).cast("int")})
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.where("other <> own or blocks = 1").select("fp", "t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    group = F.xxhash64("t", "k", "i", "j").alias("g")  # a rare clash of two groups only compares more
    dealt = rows.select(group, "fp").repartition("g").sortWithinPartitions("g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(g: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            a, b = linked(g, fp.view(np.uint64), limit)
            return fp[a], fp[b]

        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            g, fp = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            for batch in batches:
                g, fp = np.concatenate([g, batch.column(0).to_numpy()]), np.concatenate([fp, batch.column(1).to_numpy()])
                if len(g) >= ROWS:
                    cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
                    if cut:
                        yield done(g[:cut], fp[:cut])
                        g, fp = g[cut:], fp[cut:]
            if len(g):
                yield done(g, fp)

        yield from forests(found())

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Fingerprint and component of every row of `df`.

    Returns `key`, h (the text's hash), fp (signed long), root (a fingerprint that names the component) and component_id, the least `key` whose
    fingerprint links lead to. Null and empty texts have fingerprint 0 and link like any other; null keys never are a
    component_id, unless the whole component has none (null then); equal rows share a fingerprint and so a component; other
    columns are not read; an empty table gives no rows. Texts with the same fingerprint are one vertex, so that groups of
    copies are never compared.
    """
    docs = checkpoint(fingerprints(df, key, text))
    leads = checkpoint(docs.groupBy("fp").agg(F.min(key).alias("lead")))
    found = connected_components(links(leads.select("fp"), limit), shrunk=True).select(F.col("id").alias("fp"), "root")
    member = checkpoint(leads.join(found, "fp", "left").select("fp", "lead", F.coalesce("root", "fp").alias("root")))
    least = member.groupBy("root").agg(F.min("lead").alias("component_id"))
    member = skew_join(member.select("fp", "root"), least, ["root"])
    return skew_join(docs, member, ["fp"]).select(key, "h", "fp", "root", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op6_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op6_gray_simhash": op6_gray_simhash}
