"""Scaling by population moments."""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.exact import near, order_free_sums
from foldwise.functions import tiles
from foldwise.operators.coordinates import View, check_schema, coordinate, problems
from foldwise.operators.stages import Stage, Transform, checked
from foldwise.operators.tree import added, tree_fold
from foldwise.sources.rows import DataError, Rows


@dataclass(frozen=True)
class Moments:
    """Count, and mean, population variance and range of each coordinate."""

    n: int
    mean: tuple[float, ...]
    variance: tuple[float, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    names: tuple[str, ...]


def moments(rows: Rows) -> Moments:
    """All moments in two aggregates, with the first bad row found on the way; they don't depend on the order of the rows."""
    check_schema(rows.df, rows.features)
    x = [coordinate(rows.df, f) for f in rows.features]
    aggs = [a(c).alias(f"{k}{i}") for i, c in enumerate(x) for k, a in (("m", F.avg), ("l", F.min), ("h", F.max))]
    bad = F.min(F.when(problems(rows).isNotNull(), F.struct(F.col(rows.row_id).alias("row"), problems(rows).alias("p"))))
    r = rows.df.agg(F.count(F.lit(1)).alias("n"), bad.alias("bad"), *aggs).first()
    if not r["n"]:
        raise DataError("EmptyData")
    if r["bad"]:
        raise DataError(r["bad"]["p"]["code"], f"row {r['bad']['row']}, {r['bad']['p']['name']}")
    low, high = (tuple(r[f"{k}{i}"] for i in range(len(x))) for k in "lh")
    at = [near(r[f"m{i}"], l, h) for i, (l, h) in enumerate(zip(low, high))]
    off = [max(abs(l - c), abs(h - c)) for c, l, h in zip(at, low, high)]
    terms = {f"{k}{i}": (c - F.lit(at[i])) if k == "s" else (c - F.lit(at[i])) * (c - F.lit(at[i])) for i, c in enumerate(x) for k in "sq"}
    got = order_free_sums(rows.df, terms, known=(r["n"], {f"{k}{i}": o if k == "s" else o * o for i, o in enumerate(off) for k in "sq"}))[None]
    mean, variance = [], []
    for i, name in enumerate(rows.features):
        s, q = got[f"s{i}"], got[f"q{i}"]
        if s is None or q is None:
            raise DataError("NonFiniteMoment", name)
        mean.append(float(Fraction(at[i]) + s / r["n"]))
        variance.append(max(0.0, float(q / r["n"] - (s / r["n"]) ** 2)))
    return Moments(r["n"], tuple(mean), tuple(variance), low, high, rows.features)


def vector_spread(df: DataFrame, view: View, extra: list[Column] = ()) -> dict[str, np.ndarray]:
    """n, and sum, low and high of every coordinate of a view, then of the extra columns, in one pass."""
    if view.sparse:
        return _sparse_spread(df, view)
    m, k = len(view), len(extra)

    def step(batches):
        state = {"n": np.zeros(1, dtype=np.int64), "sum": np.zeros(m + k), "low": np.full(m + k, np.inf), "high": np.full(m + k, -np.inf)}
        for batch in batches:
            if len(batch):
                x = np.column_stack([view.matrix(batch, k), *[batch.column(i).to_numpy(zero_copy_only=False) for i in range(k)]])
                state = {"n": state["n"] + len(x), "sum": state["sum"] + x.sum(axis=0), "low": np.minimum(state["low"], x.min(axis=0)), "high": np.maximum(state["high"], x.max(axis=0))}
        return {None: state} if state["n"][0] else {}

    merge = lambda a, b: {"n": a["n"] + b["n"], "sum": a["sum"] + b["sum"], "low": np.minimum(a["low"], b["low"]), "high": np.maximum(a["high"], b["high"])}
    return tree_fold(df.select(*[c.cast("double").alias(f"_e{i}") for i, c in enumerate(extra)], *view.columns(df)), step, merge).get(None)


def _sparse_spread(df: DataFrame, view: View) -> dict[str, np.ndarray]:
    """The same of a sparse view: only what the rows hold is added up, and a coordinate that some row doesn't hold is zero there."""

    def step(batches):
        state = {"n": np.zeros(1, dtype=np.int64), "held": np.zeros(len(view), dtype=np.int64), "sum": np.zeros(len(view)), "low": np.full(len(view), np.inf), "high": np.full(len(view), -np.inf)}
        for batch in batches:
            x = view.rows(batch, 0)
            state["n"] += len(x)
            state["held"] += np.bincount(x.index, minlength=len(view))
            state["sum"] += np.bincount(x.index, weights=x.value, minlength=len(view))
            np.minimum.at(state["low"], x.index, x.value)
            np.maximum.at(state["high"], x.index, x.value)
        return {None: state} if state["n"][0] else {}

    merge = lambda a, b: {k: a[k] + b[k] for k in ("n", "held", "sum")} | {"low": np.minimum(a["low"], b["low"]), "high": np.maximum(a["high"], b["high"])}
    got = tree_fold(df.select(*view.columns(df)), step, merge).get(None)
    if got:
        some = got["held"] < got["n"][0]
        got["low"][some], got["high"][some] = np.minimum(got["low"][some], 0), np.maximum(got["high"][some], 0)
    return got


def vector_problem(rows: Rows, view: View) -> None:
    """Refuse the bad vector of the least row id, and sparse ones: scaled about means, they'd be sparse no longer."""
    view.written_out()
    view.check(rows.df)
    bad = rows.df.select(F.col(rows.row_id).alias("row"), view.problem(rows).alias("p")).where("p is not null").agg(F.min(F.struct("row", "p")).alias("m")).first()["m"]
    if bad:
        raise DataError(bad["p"]["code"], f"row {bad['row']}, {bad['p']['name']}")


def vector_moments(rows: Rows, view: View) -> Moments:
    """The moments of a vector column's coordinates, in three passes however many they are; they don't depend on the order of the rows."""
    vector_problem(rows, view)
    seen = vector_spread(rows.df, view)
    if seen is None:
        raise DataError("EmptyData")
    n = int(seen["n"][0])
    at = np.array([near(s / n, l, h) for s, l, h in zip(seen["sum"], seen["low"], seen["high"])])
    e = tiles.exponents(np.maximum(np.abs(seen["low"] - at), np.abs(seen["high"] - at)))

    def step(batches):
        states = [tiles.squares(view.matrix(b, 0) - at, e) for b in batches if len(b)]
        while len(states) > 1:
            states = [*states[:-2], added(states[-2], states[-1])]
        return {None: states[0]} if states else {}

    state = tree_fold(rows.df.select(*view.columns(rows.df)), step)[None]
    got = tiles.total(state, np.stack([e, 2 * e]), np.array([[tiles.BITS], [2 * tiles.BITS]]))
    mean, variance = at + got[0] / n, np.maximum(0.0, got[1] / n - (got[0] / n) ** 2)
    if not (np.isfinite(mean).all() and np.isfinite(variance).all()):
        raise DataError("NonFiniteMoment", view.names[int(np.argmin(np.isfinite(mean + variance)))])
    return Moments(n, *(tuple(map(float, x)) for x in (mean, variance, seen["low"], seen["high"])), view.names)


def inverse_deviations(m: Moments, constant: str = "emit-zero") -> tuple[float, ...]:
    """1 / population deviation of each coordinate. A constant one (its least value is its greatest: merged variances of equal values need not be 0) gives 0.0, or an error under `reject`."""
    if constant not in ("emit-zero", "reject"):
        raise DataError("UnknownPolicy", constant)
    out = []
    for name, v, low, high in zip(m.names, m.variance, m.low, m.high):
        if low == high:
            if constant == "reject":
                raise DataError("ConstantCoordinate", name)
            out.append(0.0)
        elif v == 0 or not math.isfinite(1 / math.sqrt(v)):
            raise DataError("NonFiniteScale", name)
        else:
            out.append(1 / math.sqrt(v))
    return tuple(out)


@dataclass(frozen=True)
class Scaled(Stage):
    features: tuple[str, ...]
    mean: tuple[float, ...] | None
    inverse: tuple[float, ...]
    name: str = "scaled"

    def outputs(self) -> dict[str, Column]:
        centre = self.mean or (None,) * len(self.features)
        return {f: (F.col(f).cast("double") if m is None else F.col(f).cast("double") - F.lit(m)) * F.lit(s) for f, m, s in zip(self.features, centre, self.inverse)}

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.outputs())

    def guarded(self, df: DataFrame) -> DataFrame:
        return checked(df, self.features, self.outputs())

    def inverted(self, df: DataFrame) -> DataFrame:
        """Back to the original scale; constants come back as their mean (or 0 without centring)."""
        centre = self.mean or (0.0,) * len(self.features)
        return df.withColumns({f: F.col(f) * F.lit(1 / s if s else 0.0) + F.lit(m) for f, m, s in zip(self.features, centre, self.inverse)})

    def record(self) -> dict:
        return {"mean": self.mean, "inverse": self.inverse}


@dataclass(frozen=True)
class ScaledVector(Stage):
    """A vector column scaled in place."""

    column: str
    mean: tuple[float, ...] | None
    inverse: tuple[float, ...]
    name: str = "scaled-vector"

    def scaled(self) -> Column:
        x = F.col(self.column).cast("array<double>")
        x = x if self.mean is None else F.zip_with(x, F.lit(list(self.mean)), lambda v, m: v - m)
        return F.zip_with(x, F.lit(list(self.inverse)), lambda v, s: v * s)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.column, self.scaled())

    def record(self) -> dict:
        return {"column": self.column, "mean": self.mean, "inverse": self.inverse}


class StandardScaler(Transform):
    """(x - mean) / population deviation, of the feature columns or of the vector column of `view`."""

    centres, name = True, "standard-scaler"

    def __init__(self, constant: str = "emit-zero", view: View | None = None):
        self.constant, self.view = constant, view
        if view and view.column:
            self.name = f"{self.name}:{view.column}"

    def fit(self, rows: Rows, seed: int = 0) -> Scaled | ScaledVector:
        if self.view and self.view.column:
            m = vector_moments(rows.fitting(), self.view)
            return ScaledVector(self.view.column, m.mean if self.centres else None, inverse_deviations(m, self.constant))
        return self.from_moments(moments(rows.fitting()))

    def from_moments(self, m: Moments) -> Scaled:
        """The stage that a fit on rows with these moments gives: no row is needed."""
        return Scaled(m.names, m.mean if self.centres else None, inverse_deviations(m, self.constant))


class ScaleOnlyScaler(StandardScaler):
    """x / population deviation: zeros stay zeros."""

    centres, name = False, "scale-only-scaler"
