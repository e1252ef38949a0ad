"""Metrics of scored rows (truth, prediction, weight) as mergeable aggregates, and sums that are exact in any order."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.exact import order_free_sums
from foldwise.sources.rows import DataError


@dataclass(frozen=True)
class Metric:
    """Terms whose sums, by name, make the value. Sums of all rows don't depend on the rows' order; partials by group merge in any way, up to the rounding of sums."""

    name: str
    minimize: bool
    terms: Callable[[], dict[str, Column]]
    finish: Callable[[dict], float]
    weighted: bool = False
    squares: bool = True

    def evaluate(self, scored: DataFrame) -> float:
        """The value; an error for no rows, or for the first problem of any row (see `first_problem`)."""
        r = self._checked(scored, problem_order(self.weighted, self.squares))
        if r["_p"]:
            raise DataError(KINDS[r["_p"]["kind"] - 1], str(r["_p"]["value"]))
        return self._summed(scored, r)

    def _checked(self, scored: DataFrame, problem: Column) -> dict:
        """Row count, first problem and the terms' sizes."""
        r = scored.agg(F.count(F.lit(1)).alias("_n"), problem.alias("_p"), *[F.max(F.abs(c)).alias(k) for k, c in self.terms().items()]).first().asDict()
        if not r["_n"]:
            raise DataError("Empty", self.name)
        return r

    def _summed(self, scored: DataFrame, r: dict) -> float:
        got = order_free_sums(scored, self.terms(), known=(r["_n"], {k: float(r[k] or 0) for k in self.terms()}))[None]
        return self.finish({k: float("inf") if v is None else float(v) if k != "_n" else v for k, v in got.items()})

    def by(self, scored: DataFrame, *keys: str) -> DataFrame:
        """Partials of each group, for scores by fold or candidate in one pass."""
        return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(k) for k, c in self.terms().items()])

    def better(self, a: float, b: float) -> bool:
        return a < b if self.minimize else a > b


KINDS = ("NonFiniteTruth", "NonFinitePrediction", "NonFiniteResidual", "NonFiniteSquaredError", "NonFiniteWeight", "NegativeWeight", "NonFiniteWeightedValue")


def bits(c: Column) -> Column:
    """The raw bits of a double as a long, by arithmetic; every NaN has those of the usual one."""
    size, one = F.abs(c), F.lit(1).cast("long")
    e = F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022))  # off by one at most; what is left of the number tells
    m = size / F.pow(F.lit(2.0), e)
    normal = lambda e, m: F.shiftleft(e + 1023, 52) + ((m - 1) * 2.0**52).cast("long")
    finite = F.when(m >= 2, normal(e + one, m / 2)).when(m < 1, normal(e - one, m * 2)).otherwise(normal(e, m))
    least = (size * 2.0**537 * 2.0**537).cast("long")  # below the least normal number: in units of 2**-1074
    magnitude = F.when(size < 2.0**-1022, least).when(size == float("inf"), F.lit(2047 << 52)).otherwise(finite)
    negative = (c < 0) | ((c == 0) & (F.pow(c, F.lit(-1.0)) < 0))
    return F.when(F.isnan(c), F.lit(4095 << 51)).when(negative, magnitude + F.lit(-(1 << 63))).otherwise(magnitude)


def _unfit(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def problem(weighted: bool, squares: bool = True) -> Column:
    """The first problem of a row as (kind, first, second, value), or null; kinds are numbered as in KINDS. Values compare as their raw bits do without a sign: negative ones last, by size."""
    t, p = F.col("truth").cast("double"), F.col("prediction").cast("double")
    w = F.col("weight").cast("double") if weighted else F.lit(1.0)
    order = lambda v: F.struct((v < 0).alias("negative"), F.abs(v).alias("size"))
    of = lambda kind, a, b=None: F.struct(F.lit(kind).alias("kind"), order(a).alias("first"), order(F.lit(0.0) if b is None else b).alias("second"), a.alias("value"))
    found = F.when(_unfit(t), of(1, t)).when(_unfit(p), of(2, p))
    if squares:
        found = found.when(_unfit(t - p), of(3, t, p)).when(_unfit((t - p) * (t - p)), of(4, (t - p)))
    if weighted:
        found = found.when(_unfit(w), of(5, w)).when(w < 0, of(6, w))
        if squares:
            found = found.when(_unfit(w * (t - p) * (t - p)), of(7, (t - p) * (t - p), w))
    return found


def problem_order(weighted: bool, squares: bool = True) -> Column:
    return F.min(problem(weighted, squares))


def first_problem(scored: DataFrame, weighted: bool = False) -> DataFrame:
    """(kind, value) of the least problem of all rows, by kind, then bits: the same for every order of the rows."""
    m = scored.agg(problem_order(weighted).alias("p")).where("p is not null")
    names = F.array(*map(F.lit, KINDS))
    return m.select(F.element_at(names, F.col("p.kind")).alias("kind"), "p.value")


def _ratio(r: dict, a: str, b: str) -> float:
    if not r[b]:
        raise DataError("ZeroTotalWeight")
    return r[a] / r[b]


def _squares(weighted: bool) -> Column:
    d = F.col("truth").cast("double") - F.col("prediction").cast("double")
    return d * d * F.col("weight").cast("double") if weighted else d * d


def rmse() -> Metric:
    return Metric("rmse", True, lambda: {"s": _squares(False)}, lambda r: math.sqrt(r["s"] / r["_n"]))


def weighted_rmse() -> Metric:
    return Metric("weighted-rmse", True, lambda: {"s": _squares(True), "w": F.col("weight").cast("double")}, lambda r: math.sqrt(_ratio(r, "s", "w")), weighted=True)


@dataclass(frozen=True)
class Accuracy(Metric):
    """Labels of any type under a named equality; nulls are no label and count as wrong, so they are no problem either."""

    def evaluate(self, scored: DataFrame) -> float:
        bad = F.min(F.when(_unfit(F.col("weight").cast("double")), 5).when(F.col("weight") < 0, 6)) if self.weighted else F.lit(None).cast("int")
        r = self._checked(scored, F.max(bad) if not self.weighted else bad)
        if r["_p"]:
            raise DataError(KINDS[r["_p"] - 1])
        return self._summed(scored, r)


def accuracy(same: Callable[[Column, Column], Column] | None = None, policy: str = "equals") -> Metric:
    right = lambda: F.coalesce((same or (lambda a, b: a == b))(F.col("truth"), F.col("prediction")), F.lit(False))
    return Accuracy(f"accuracy:{policy}", False, lambda: {"s": right().cast("int")}, lambda r: r["s"] / r["_n"], squares=False)


def weighted_accuracy(same: Callable[[Column, Column], Column] | None = None, policy: str = "equals") -> Metric:
    right = lambda: F.coalesce((same or (lambda a, b: a == b))(F.col("truth"), F.col("prediction")), F.lit(False))
    w = F.col("weight").cast("double")
    return Accuracy(f"weighted-accuracy:{policy}", False, lambda: {"s": F.when(right(), w).otherwise(0.0), "w": w}, lambda r: _ratio(r, "s", "w"), weighted=True, squares=False)


def exact_parts(df: DataFrame, value: Column) -> DataFrame:
    """(exponent, high, low): integer sums of the significands' halves by exponent, some 2,000 rows at most, whatever the data's size or order."""
    b = bits(value.cast("double"))
    rows = df.where(value.isNotNull()).select(b.alias("b"))
    e, f = F.shiftright("b", 52).bitwiseAND(F.lit(2047)), F.col("b").bitwiseAND(F.lit((1 << 52) - 1))
    significand = F.when(e == 0, f).otherwise(f + F.lit(1 << 52))
    sign = F.when(F.col("b") < 0, -1).otherwise(1)
    rows = rows.select(F.greatest(e, F.lit(1).cast("long")).alias("exponent"), (sign * F.shiftright(significand, 26)).alias("high"), (sign * significand.bitwiseAND(F.lit((1 << 26) - 1))).alias("low"))
    return rows.groupBy("exponent").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))


def exact_sum(df: DataFrame, value: Column) -> float:
    """The correctly rounded sum of a column (null left out): the same bits for every order and partitioning. 0.0 for no rows; non-finite values are refused."""
    total = 0
    for r in exact_parts(df, value).collect():
        if r["exponent"] == 2047:
            raise DataError("NonFinite")
        total += ((r["high"] << 26) + r["low"]) << (r["exponent"] - 1)  # in units of 2**-1074
    return float(Fraction(total, 1 << 1074)) if total else 0.0


def exact_rmse(scored: DataFrame) -> float:
    """RMSE whose sum of squares is exact."""
    n = scored.count()
    if not n:
        raise DataError("Empty", "rmse")
    return math.sqrt(exact_sum(scored, _squares(False)) / n)


def equivalent(a: float, b: float, absolute: float, relative: float) -> bool:
    return abs(a - b) <= max(absolute, relative * max(abs(a), abs(b)))


def equivalent_columns(a: Column, b: Column, absolute: float, relative: float) -> Column:
    """The same test of two columns of doubles."""
    return F.abs(a - b) <= F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(a), F.abs(b)))
