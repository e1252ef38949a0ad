"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. Each source's budget is met by whole passes over it, then by a
proportional share of every length, and the words still missing by a bounded-knapsack dynamic programme over the lengths.
Within a length, documents are chosen by a seeded hash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.llm.common import table, words
from foldwise.operators.state import checkpoint, global_position

SHARE, WEIGHTS, MOST_COPIES, SEED = 1.5, (5, 2, 1), 2, 11
#: Documents of one source and length that are ranked together, on average.
CELL = 250
#: The last words of a budget are fitted by the dynamic programme alone: twice the longest text's, within these bounds.
ROOM = (2048, 1 << 20)


def fit_budget(budget: int, sizes: np.ndarray, counts: np.ndarray, most_copies: int = MOST_COPIES) -> tuple[int, np.ndarray]:
    """Copies of every document, and how many documents of each size get one more, so that the words come to `budget` or just below.

    sizes: distinct positive sizes; counts: documents of each. All of the budget but the last words (ROOM) is spread over all
    sizes in proportion; what that rounds off goes to the sizes of most documents. The rest is fitted by the dynamic
    programme, whose bits are the reachable sums; it also starts with the sizes of most documents. Of n steps the bits before
    2 * sqrt(n) are held at once.
    """
    extra = np.zeros(len(sizes), dtype=np.int64)
    total = int((sizes * counts).sum())
    if total == 0:
        return 0, extra
    base = min(budget // total, most_copies)
    rest = budget - base * total
    if base == most_copies or rest <= 0:
        return base, extra
    order, room = np.lexsort((-sizes, -counts)), min(max(2 * int(sizes.max()), ROOM[0]), ROOM[1])
    spread = max(0, rest - room)
    extra = np.array([int(c) * spread // total for c in counts.tolist()], dtype=np.int64)
    rest -= int((extra * sizes).sum())
    left = counts - extra
    for i in order.tolist():
        more = min(int(left[i]), max(0, rest - room) // int(sizes[i]))
        extra[i] += more
        left[i] -= more
        rest -= more * int(sizes[i])
    mask, steps = (1 << (rest + 1)) - 1, []
    for i in order.tolist():
        many, unit = min(int(left[i]), rest // int(sizes[i])), 1
        while many > 0:
            take = min(unit, many)  # a count is split into 1, 2, 4, ... and the remainder
            steps.append((i, take))
            many -= take
            unit *= 2
    forward = lambda reach, i, take: reach | reach << take * int(sizes[i]) & mask
    # of the bits before each step every k-th is kept; those between are worked out again on the way back
    k, reach, kept, done = max(1, math.isqrt(len(steps))), 1, [], 0
    while done < len(steps) and not reach >> rest & 1:
        if done % k == 0:
            kept.append(reach)
        reach, done = forward(reach, *steps[done]), done + 1
    at = reach.bit_length() - 1
    for block in range(len(kept) - 1, -1, -1):
        some = steps[block * k : min(done, block * k + k)]
        before = [kept[block]]
        for step in some[:-1]:
            before.append(forward(before[-1], *step))
        for bits, (i, take) in zip(reversed(before), reversed(some)):
            if not bits >> at & 1:
                at -= take * int(sizes[i])
                extra[i] += take
    return base, extra


def targets(sources: DataFrame, share: float, weights: tuple[int, ...], most_copies: int) -> DataFrame:
    """Add `target` to (source, source_size): the share of all words by weight, capped at `most_copies` sizes, the excess reshared."""
    ranked = global_position(sources, [F.col("source").asc_nulls_last()])
    ranked = checkpoint(ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("pos", F.lit(len(weights))) + 1).cast("int")).cast("double")))
    cap = (F.col("source_size") * most_copies).cast("double")
    words = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level = -1.0
    while True:  # all sources below the level are capped; it rises until it stays
        over = cap < F.col("weight") * F.lit(level)
        r = ranked.agg(F.sum(F.when(over, cap)).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("w")).first()
        if not r["w"] or (new := (words - (r["capped"] or 0.0)) / r["w"]) <= level:
            break
        level = new
    return ranked.select("source", "source_size", F.greatest(F.least(cap, F.col("weight") * F.lit(level)), F.lit(0.0)).alias("target"))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most_copies: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """How often the mix takes each row of `df`.

    Returns doc_id, text_hash, source, size, source_size, target, copies and taken (copies * size). A null text has no words; rows
    without words are never taken. The null source comes last. Ties of the seeded order are broken by `key`; equal rows are
    interchangeable and ranked as one row with a count. Other columns are not read; an empty table gives no rows. A source and length with many documents is
    ranked in cells of about CELL documents, whose quotas are running differences of the cells' counts.
    """
    docs = df.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size"), F.xxhash64(text).alias("text_hash"))
    docs = docs.groupBy("doc_id", "source", "size", "text_hash").agg(F.count(F.lit(1)).alias("alike"))
    docs = checkpoint(docs.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_hash")))
    lengths = checkpoint(docs.groupBy("source", "size").agg(F.sum("alike").alias("n")))
    sources = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")), share, weights, most_copies)

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size").reset_index(drop=True)
        real = group["size"].to_numpy() > 0
        base, extra = fit_budget(int(np.floor(group["target"].iloc[0] + 0.5)), group["size"].to_numpy()[real], group["n"].to_numpy()[real], most_copies)
        out = group[["source", "size", "n", "source_size", "target"]].assign(base=np.where(real, base, 0), more=0)
        out.loc[real, "more"] = extra
        return out

    s = sources.withColumnRenamed("source", "_s")
    plan = lengths.join(s, lengths["source"].eqNullSafe(s["_s"])).drop("_s").groupBy("source").applyInPandas(fitted, "source string, size long, n long, source_size long, target double, base long, more long")
    plan = checkpoint(plan).withColumnsRenamed({"source": "_s", "size": "_z"})
    docs = docs.join(plan, docs["source"].eqNullSafe(plan["_s"]) & (docs["size"] == plan["_z"])).drop("_s", "_z")
    docs = docs.withColumn("cell", F.pmod("h", F.ceil(F.col("n") / CELL)))
    some = docs.where((F.col("more") > 0) & (F.col("more") < F.col("n")))
    cells = some.groupBy("source", "size", "cell", "more").agg(F.sum("alike").alias("c"))
    before = F.sum("c").over(Window.partitionBy("source", "size").orderBy("cell")) - F.col("c")
    cells = cells.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("cell").alias("_c"), (F.col("more") - before).alias("quota"))
    first = F.sum("alike").over(Window.partitionBy("source", "size", "cell").orderBy("h", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)) - F.col("alike")
    some = some.withColumn("first", first).join(cells, some["source"].eqNullSafe(cells["_s"]) & (some["size"] == cells["_z"]) & (some["cell"] == cells["_c"]))
    some = some.withColumn("chosen", F.greatest(F.least(F.col("quota") - F.col("first"), "alike"), F.lit(0)))
    rest = docs.where((F.col("more") == 0) | (F.col("more") == F.col("n"))).withColumn("chosen", F.when(F.col("more") > 0, F.col("alike")).otherwise(0))
    columns = ["doc_id", "text_hash", "source", "size", "source_size", "target"]
    out = some.select(*columns, "base", "chosen", "alike").unionByName(rest.select(*columns, "base", "chosen", "alike"))
    out = out.select(*columns, "base", "chosen", F.explode(F.sequence(F.lit(1).cast("long"), F.col("alike"))).alias("number"))
    out = out.select(*columns, (F.col("base") + (F.col("number") <= F.col("chosen")).cast("long")).alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def op9_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES = {"op9_subset_sum_mix": op9_subset_sum_mix}
