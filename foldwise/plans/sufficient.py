"""Fits and scores from sufficient statistics: one pass over the rows gives every fold, origin and candidate.

A chain of maps, scalers and a ridge regression sees its rows through their Gram sums alone: maps are columns, a scaler's
moments are the sums' diagonal, the scaled rows' sums follow from the rows' own, and so do a model's squares on any group.
Sums of groups add up; only whole numbers are subtracted, which is exact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions import tiles
from foldwise.operators import ridge
from foldwise.operators.coordinates import View
from foldwise.operators.resampling import RollingPlan
from foldwise.operators.ridge import Gram
from foldwise.operators.scalers import Moments, ScaleOnlyScaler, StandardScaler, inverse_deviations
from foldwise.operators.stages import Blueprint, Mapped, Named
from foldwise.operators.state import written
from foldwise.operators.tree import tree_fold
from foldwise.sources.rows import DataError, Rows


@dataclass(frozen=True)
class Chain:
    """A blueprint whose fit needs Gram sums only: its maps, scalers, and ridge regression."""

    maps: tuple[Named, ...]
    scalers: tuple[StandardScaler, ...]
    learner: ridge.Ridge

    @classmethod
    def of(cls, blueprint: Blueprint) -> Chain | None:
        """The chain of a blueprint, or None if it has other parts, or maps behind a scaler."""
        *before, learner = blueprint.parts or (None,)
        if type(learner) is not ridge.Ridge or not isinstance(ridge.BACKENDS[learner.config.solver], ridge.GramBackend):
            return None
        maps = [p for p in before if type(p) is Mapped]
        scalers = [p for p in before if type(p) in (StandardScaler, ScaleOnlyScaler)]
        if before != [*maps, *scalers] or any(_column(s) != _column(learner) for s in scalers):
            return None
        return cls(tuple(m.stage for m in maps), tuple(scalers), learner)

    def mapped(self, rows: Rows) -> Rows:
        for stage in self.maps:
            rows = rows.with_df(stage.apply(rows.df), features=stage.features or rows.features)
        return rows

    @property
    def source(self) -> tuple:
        """What the sums are of: chains that agree in it share a pass."""
        return tuple((m.label, m.version, tuple(map(str, m.outputs.values())), m.features) for m in self.maps), self.learner.weighted, _column(self.learner)

    def fit(self, sums: Gram, counts: Gram) -> Fit:
        """The fit from the rows' weighted sums and their unweighted ones."""
        steps = []
        for scaler in self.scalers:
            mean = counts.sx / counts.n + counts.centre
            variance = np.maximum(0.0, np.diag(counts.sxx) / counts.n - (counts.sx / counts.n) ** 2)
            names = tuple(map(str, range(len(mean))))
            inverse = np.array(inverse_deviations(Moments(counts.n, tuple(mean), tuple(variance), tuple(counts.low), tuple(counts.high), names), scaler.constant))
            steps.append((mean if scaler.centres else None, inverse))
            sums, counts = sums.scaled(*steps[-1]), counts.scaled(*steps[-1])
        beta, intercept, _ = ridge.solve(sums, self.learner.config)
        return Fit(tuple(steps), beta, intercept)


@dataclass(frozen=True)
class Fit:
    """Scaling steps, and coefficients and intercept for what they give out."""

    steps: tuple
    coefficients: np.ndarray
    intercept: float

    def squares(self, sums: Gram) -> float:
        """The model's sum of squared residuals over other rows, from their sums."""
        for step in self.steps:
            sums = sums.scaled(*step)
        return max(0.0, sums.squares(self.coefficients, self.intercept))

    def raw(self) -> tuple[np.ndarray, float]:
        """Coefficients and intercept for the rows as they are."""
        beta, b0 = self.coefficients, self.intercept
        for mean, inverse in reversed(self.steps):
            beta = beta * inverse
            b0 = b0 if mean is None else b0 - float(beta @ mean)
        return beta, b0


def _column(part) -> str | None:
    return part.view.column if part.view else None


def sums_by(rows: Rows, chain: Chain, by: str | None) -> tuple[dict, dict]:
    """The weighted and the unweighted sums of the mapped rows, by the column `by`; the same ones without weights."""
    rows, view = chain.mapped(rows), chain.learner.view
    at = ridge.centre(rows, chain.learner.weighted, view)
    weighted = ridge.grams(rows, chain.learner.weighted, at, by, view)
    if not (chain.learner.weighted and chain.scalers):
        return weighted, weighted
    return weighted, ridge.grams(rows, False, at, by, view)


def rest(by: dict) -> dict:
    """For each group the sum of all others, from sums up to it and beyond it."""
    keys, out = list(by), {}
    before, after = [None], [None]
    for k in keys:
        before.append(by[k] if before[-1] is None else before[-1] + by[k])
    for k in reversed(keys):
        after.append(by[k] if after[-1] is None else after[-1] + by[k])
    for i, k in enumerate(keys):
        a, b = before[i], after[len(keys) - 1 - i]
        out[k] = b if a is None else a if b is None else a + b
    return out


@dataclass(frozen=True)
class Origin:
    """One fold of a rolling evaluation: its range of analysis and assessment rows by position, the model and its score."""

    fold: int
    start: int
    end: int
    fit: Fit
    score: float


#: Parts into which blocks are dealt for running sums (the driver gets a state for each), and blocks that a task gives out at once.
PARTS, AT_ONCE = 256, 1024
_STATE = "block long, part long, sums binary, range binary"


def _flat(block: int, part: int, s: dict) -> dict:
    sums, span = np.concatenate([s["high"].ravel(), s["low"].ravel(), s["n"]]), np.concatenate([s["least"], s["most"]])
    return {"block": block, "part": part, "sums": sums.tobytes(), "range": span.tobytes()}


def _state(sums: bytes, span: bytes) -> dict:
    """A state from its bytes; sums are whole numbers, so that those of a range are exactly the difference of two running sums."""
    x, r = np.frombuffer(sums, dtype=np.int64), np.frombuffer(span, dtype=float)
    shape = (tiles.LIMBS, len(r) // 2 + 2, len(r) // 2 + 2)
    half = len(x) // 2
    return {"high": x[:half].reshape(shape), "low": x[half:-1].reshape(shape), "n": x[-1:], "least": r[: len(r) // 2], "most": r[len(r) // 2 :]}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("block", pa.int64()), ("part", pa.int64()), ("sums", pa.binary()), ("range", pa.binary())]))


def _running(rows: Rows, chain: Chain, weighted: bool, at: ridge.Centre, sums: ridge.Sums, last: int) -> tuple[DataFrame, np.ndarray]:
    """(block, sums, range): each block's state and all before it; and the mean of all rows, about the point. Tasks add up parts of neighbouring blocks, beginning with what lies before a part."""
    width = -(-(last + 1) // PARTS)
    frame, step = ridge.states(rows, weighted, sums, "_block", chain.learner.view, AT_ONCE)

    def own(batches):
        for held in step(batches):
            if held:
                yield _batch([_flat(b, b // width, s) for b, s in held.items()])

    blocks = written(frame.mapInArrow(own, _STATE))

    def by_part(batches):
        out: dict = {}
        for batch in batches:
            for r in batch.to_pylist():
                s = _state(r["sums"], r["range"])
                out[r["part"]] = ridge.merged(out[r["part"]], s) if r["part"] in out else s
        return out

    before, total = {}, None
    for part, s in sorted(tree_fold(blocks, by_part, ridge.merged).items()):
        before[part] = total
        total = s if total is None else ridge.merged(total, s)
    g, begin = sums.matrix(total), rows.df.sparkSession.sparkContext.broadcast(before)

    def add(batches):
        block = part = state = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if block is not None and r["block"] != block:
                    out.append(_flat(block, part, state))
                if r["part"] != part:
                    part, state = r["part"], begin.value[r["part"]]
                block, s = r["block"], _state(r["sums"], r["range"])
                state = s if state is None else ridge.merged(state, s)
            if out:
                yield _batch(out)
        if block is not None:
            yield _batch([_flat(block, part, state)])

    running = blocks.repartition("part").sortWithinPartitions("part", "block").mapInArrow(add, _STATE).drop("part")
    return running, g[:-1, -1] / g[-1, -1] if g[-1, -1] else np.zeros(len(g) - 1)


def rolling_frame(plan: RollingPlan, blueprint: Blueprint) -> DataFrame:
    """(fold, start, end, score, steps, coefficients, intercept) of every origin: each model is fitted on all rows before it, its (weighted) RMSE is of the rows of its window.

    One pass: positions are cut at all windows' beginnings and ends, each block between two cuts has its Gram sums, running
    sums of blocks are the analysis rows, and a window is the difference of two. Sums, fits and scores stay in tasks, whatever
    the number of origins. The maps of the blueprint must work on single rows; a blueprint that isn't a chain of maps,
    scalers and ridge is refused. The first origin's error is raised.
    """
    chain = Chain.of(blueprint)
    if chain is None:
        raise DataError("NotSufficient", " > ".join(blueprint.plan))
    rows = chain.mapped(plan.rows.with_df(plan.rows.df.withColumn("_block", plan.block(F.col("pos")))))
    at, last = ridge.centre(rows, chain.learner.weighted, chain.learner.view), plan.block_of(plan.n - 1)
    kinds = [chain.learner.weighted, *([False] if chain.learner.weighted and chain.scalers else [])]
    scales = [ridge.Sums.about(at, w) for w in kinds]
    start = F.col("fold") * plan.step + plan.initial
    found = rows.df.sparkSession.range(plan.folds).select(F.col("id").alias("fold")).withColumn("start", start).withColumn("end", F.least(start + plan.assess, F.lit(plan.n)))
    found, means = found.withColumn("_from", plan.block(F.col("start") - 1)).withColumn("_to", plan.block(F.col("end") - 1)), []
    for i, (weighted, scale) in enumerate(zip(kinds, scales)):
        running, mean = _running(rows, chain, weighted, at, scale, last)
        running = written(running)
        means.append(mean)
        for side in ("from", "to") if i == 0 else ("from",):
            found = found.join(running.select(F.col("block").alias(f"_{side}"), F.col("sums").alias(f"{side}{i}"), F.col("range").alias(f"{side}_range{i}")), f"_{side}")
    plain, schema = Chain((), chain.scalers, chain.learner), pa.schema([("fold", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("steps", pa.list_(pa.struct([("mean", pa.list_(pa.float64())), ("inverse", pa.list_(pa.float64()))]))), ("coefficients", pa.list_(pa.float64())), ("intercept", pa.float64()), ("error", pa.list_(pa.string()))])

    def fitted(r: dict) -> dict:
        out = dict.fromkeys(schema.names) | {k: r[k] for k in ("fold", "start", "end")}
        try:
            known = [_state(r[f"from{i}"], r[f"from_range{i}"]) for i in range(len(scales))]
            sums = [scale.gram(scale.matrix(s), mean, s) for scale, s, mean in zip(scales, known, means)]
            fit = plain.fit(sums[0], sums[-1])
            until = _state(r["to0"], r["to_range0"])
            inside = until | {k: until[k] - known[0][k] for k in ("high", "low", "n")}
            window = scales[0].gram(scales[0].matrix(inside), means[0], inside)
            if window.sw <= 0:
                raise DataError("ZeroTotalWeight", f"origin {r['fold']}")
            steps = [{"mean": None if mean is None else list(mean), "inverse": list(inverse)} for mean, inverse in fit.steps]
            return out | {"score": math.sqrt(fit.squares(window) / window.sw), "steps": steps, "coefficients": list(fit.coefficients), "intercept": fit.intercept}
        except DataError as e:
            return out | {"error": [e.code, str(e)[len(e.code) + 2 :]]}

    def run(batches):
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_pylist([fitted(r) for r in batch.to_pylist()], schema=schema)

    out = written(found.mapInArrow(run, "fold int, start long, end long, score double, steps array<struct<mean:array<double>,inverse:array<double>>>, coefficients array<double>, intercept double, error array<string>"))
    bad = out.where("error is not null").agg(F.min(F.struct("fold", "error")).alias("m")).first()["m"]
    if bad:
        raise DataError(*bad["error"])
    return out.drop("error")


def rolling_scores(plan: RollingPlan, blueprint: Blueprint) -> list[Origin]:
    """The origins of `rolling_frame` on the driver, by fold: a model of d numbers each."""
    out = []
    for r in rolling_frame(plan, blueprint).orderBy("fold").collect():
        steps = tuple((None if s["mean"] is None else np.array(s["mean"]), np.array(s["inverse"])) for s in r["steps"])
        out.append(Origin(r["fold"], r["start"], r["end"], Fit(steps, np.array(r["coefficients"]), r["intercept"]), r["score"]))
    return out


def fold_scores(chains: list[Chain | None], rows: Rows, fold: str) -> list[list[float] | Exception]:
    """(Weighted) RMSE of every chain in every fold, by fold: one pass for all chains of the same source, whatever the number of folds and chains."""
    shared: dict = {}
    out: list = []
    for chain in chains:
        try:
            if chain.source not in shared:
                weighted, counts = sums_by(rows, chain, fold)
                if len(weighted) < 2:
                    raise DataError("TooFewFolds", str(len(weighted)))
                shared[chain.source] = weighted, rest(weighted), weighted if counts is weighted else rest(counts), counts is weighted
            weighted, others, unweighted, same = shared[chain.source]
            scores = []
            for k, own in weighted.items():
                fit = chain.fit(others[k], others[k] if same else unweighted[k])
                if own.sw <= 0:
                    raise DataError("ZeroTotalWeight", f"fold {k}")
                scores.append(math.sqrt(fit.squares(own) / own.sw))
            out.append(scores)
        except DataError as e:
            out.append(e)
    return out
