"""Sums of doubles that are the same for every order and partitioning of the rows, up to far below a double's precision."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits that each term keeps below the greatest term's leading one.
KEPT = 80


def bounds(df: DataFrame, terms: dict[str, Column]) -> tuple[int, dict[str, float]]:
    """The number of rows and the greatest size of each term (0.0 without rows)."""
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.max(F.abs(c)).alias(f"b{i}") for i, c in enumerate(terms.values())]).first()
    return r["n"], {k: r[f"b{i}"] or 0.0 for i, k in enumerate(terms)}


def order_free_sums(df: DataFrame, terms: dict[str, Column], by: str | None = None, known: tuple[int, dict[str, float]] | None = None) -> dict:
    """{group: {term: Fraction}} of the terms' sums over all rows (group None) or by the column `by`; `known`: row count and sizes as of `bounds`.

    Each term is cut into whole numbers of so few bits that their sums fit a long, however many rows there are; whole
    numbers add up alike in any order. Nulls are left out. A term whose greatest size isn't finite sums to None.
    """
    n, size = known or bounds(df, terms)
    bits = min(50, 62 - max(1, n + 1).bit_length())
    parts = math.ceil(KEPT / bits)
    finite = {k: c for k, c in terms.items() if math.isfinite(size[k])}
    power = {k: max(-900, math.frexp(size[k])[1]) for k in finite}
    group = [F.col(by).alias("_by")] if by else []
    rows = df.select(*group, *[(F.coalesce(c.cast("double"), F.lit(0.0)) * F.lit(math.ldexp(1.0, bits - power[k]))).alias(f"_{i}") for i, (k, c) in enumerate(finite.items())])
    named, sums = [f"_{i}" for i in range(len(finite))], []
    for p in range(parts):
        whole = [F.floor(c).alias(f"{c}_{p}") for c in named]
        done = [f"{c}_{q}" for c in named for q in range(p)]
        rows = rows.select(*(["_by"] if by else []), *done, *named, *whole)
        rows = rows.withColumns({c: (F.col(c) - F.col(f"{c}_{p}")) * F.lit(float(1 << bits)) for c in named})
        sums += [F.sum(f"{c}_{p}").alias(f"{c}_{p}") for c in named]
    got = (rows.groupBy("_by") if by else rows.groupBy()).agg(F.count(F.lit(1)).alias("_n"), *sums).collect()
    out = {}
    for r in got:
        total = {k: sum(Fraction(r[f"_{i}_{p}"] or 0, 1 << bits * p) for p in range(parts)) * Fraction(2) ** (power[k] - bits) for i, k in enumerate(finite)}
        out[r["_by"] if by else None] = {k: total.get(k) for k in terms} | {"_n": r["_n"]}
    return out


def near(mean: float, low: float, high: float) -> float:
    """A round number close to `mean`, as seen from the range: it doesn't change with the last bits of a sum in another order."""
    spread = high - low
    if not (math.isfinite(mean) and math.isfinite(spread)) or spread <= 0:
        return low if math.isfinite(low) else 0.0
    grid = math.ldexp(1.0, max(-900, math.frexp(spread)[1] - 10))
    return round(mean / grid) * grid
