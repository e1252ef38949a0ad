"""Configuration spaces, grid and random candidates, and cross-validated selection."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from foldwise.functions.hashing import GAMMA, MASK, finalize
from foldwise.operators import ridge
from foldwise.operators.metrics import Metric
from foldwise.operators.resampling import Plan
from foldwise.operators.stages import Blueprint
from foldwise.plans.sufficient import Chain, fold_scores, rest
from foldwise.sources.rows import DataError, Role, Rows


class Stream:
    """SplitMix64 as a stream of integers below n and of doubles in [0, 1)."""

    def __init__(self, seed: int):
        self.state = seed & MASK

    def word(self) -> int:
        self.state = (self.state + GAMMA) & MASK
        return finalize(self.state)

    def below(self, n: int) -> int:
        return (self.word() >> 1) % n

    def unit(self) -> float:
        return (self.word() >> 11) * 2.0**-53


@dataclass(frozen=True)
class Space:
    """Values by grid (of so many points for a continuous range) and by draw."""

    grid: Callable[[int], list]
    draw: Callable[[Stream], object]

    def map(self, f: Callable) -> Space:
        return Space(lambda k: [f(x) for x in self.grid(k)], lambda s: f(self.draw(s)))

    def __mul__(self, other: Space) -> Space:
        """Pairs, the left one varying slowest; its value is drawn first."""
        return Space(lambda k: list(itertools.product(self.grid(k), other.grid(k))), lambda s: (self.draw(s), other.draw(s)))


def constant(x) -> Space:
    return Space(lambda k: [x], lambda s: x)


def choice(*values) -> Space:
    if not values:
        raise DataError("EmptyChoice")
    return Space(lambda k: list(values), lambda s: values[s.below(len(values))])


def int_range(low: int, high: int) -> Space:
    """Positive integers, both ends included."""
    if not 0 < low <= high:
        raise DataError("InvalidRange", f"{low} to {high}")
    return Space(lambda k: list(range(low, high + 1)), lambda s: low + s.below(high - low + 1))


def log_uniform(low: float, high: float) -> Space:
    if not (0 < low <= high and math.isfinite(high)):
        raise DataError("InvalidRange", f"{low} to {high}")
    a, b = math.log(low), math.log(high)
    return Space(lambda k: [low] if k == 1 else [math.exp(a + i * (b - a) / (k - 1)) for i in range(k)], lambda s: math.exp(a + s.unit() * (b - a)))


def grid(space: Space, points: int) -> list:
    if points < 1:
        raise DataError("InvalidPoints", str(points))
    return space.grid(points)


def random(space: Space, trials: int, seed: int) -> list:
    if trials < 1:
        raise DataError("InvalidTrials", str(trials))
    stream = Stream(seed)
    return [space.draw(stream) for _ in range(trials)]


@dataclass(frozen=True)
class Trial:
    index: int
    candidate: object
    objective: float | None
    error: str | None = None
    folds: tuple[float, ...] = ()


def select(trials: list[Trial], minimize: bool) -> Trial:
    """The best trial with a finite objective; of equals the first."""
    good = [t for t in trials if t.error is None and t.objective is not None and math.isfinite(t.objective)]
    if not good:
        raise DataError("NoSuccessfulTrial")
    return min(good, key=lambda t: (t.objective if minimize else -t.objective, t.index))


def study(candidates: list, evaluate: Callable[[object], float], minimize: bool = True) -> tuple[Trial, list[Trial]]:
    """Evaluate all candidates; one that raises DataError or gives a non-finite objective has failed."""
    trials = []
    for i, c in enumerate(candidates):
        try:
            x = evaluate(c)
            trials.append(Trial(i, c, x if math.isfinite(x) else None, None if math.isfinite(x) else "NonFiniteObjective"))
        except DataError as e:
            trials.append(Trial(i, c, None, str(e)))
    return select(trials, minimize), trials


def cross_validated(candidates: list, blueprint: Callable[[object], Blueprint], plan: Plan, metric: Metric, seed: int, truth: str) -> tuple[Trial, list[Trial]]:
    """Mean objective over the folds of each candidate, for any blueprint. Any failed fold fails its candidate; fold models are dropped.

    Blueprints of maps, scalers and ridge regressions are scored by RMSE from one pass over the rows for all folds and candidates together
    (see `sufficient`). Others take a fit and a score for each fold.
    """
    chains = [Chain.of(blueprint(c)) for c in candidates]
    one_pass = [i for i, c in enumerate(chains) if c and truth == plan.rows.target and metric.name == ("weighted-rmse" if c.learner.weighted else "rmse")]
    found = dict(zip(one_pass, fold_scores([chains[i] for i in one_pass], plan.rows, "fold"))) if plan.complete else {}

    def one(i: int) -> Trial:
        scores = []
        for k in range(plan.folds):
            fitted = blueprint(candidates[i]).fit(plan.analysis(k).with_df(plan.analysis(k).df.drop("fold"), role=Role.TRAIN), seed)
            scores.append(metric.evaluate(fitted.apply(plan.assessment(k).df).withColumnRenamed(truth, "truth")))
        return trial(i, scores)

    def trial(i: int, scores: list[float]) -> Trial:
        mean = sum(scores) / len(scores)
        good = math.isfinite(mean)
        return Trial(i, candidates[i], mean if good else None, None if good else "NonFiniteObjective", tuple(scores))

    trials = []
    for i, c in enumerate(candidates):
        try:
            if isinstance(found.get(i), DataError):
                raise found[i]
            trials.append(trial(i, found[i]) if i in found else one(i))
        except DataError as e:
            trials.append(Trial(i, c, None, str(e)))
    return select(trials, metric.minimize), trials


def ridge_grid(rows: Rows, plan: Plan, penalties: list[float], weighted: bool = False, intercept: bool = True) -> tuple[Trial, list[Trial]]:
    """Cross-validated RMSE of every penalty in two scans: one for the centre, one for each fold's Gram sums.

    A fold's analysis sums are the other folds' added up (nothing is subtracted), each penalty is a small solve, and the
    assessment's squares follow from its own sums. With weights the score is the weighted RMSE.
    """
    at = ridge.centre(plan.rows, weighted)
    by = ridge.grams(plan.rows, weighted, at, "fold")
    if len(by) < 2:
        raise DataError("TooFewFolds", str(len(by)))
    others = rest(by)
    trials = []
    for i, penalty in enumerate(penalties):
        try:
            scores = []
            for k in sorted(by):
                beta, b0, _ = ridge.solve(others[k], ridge.Config(penalty, intercept))
                scores.append(math.sqrt(max(0.0, by[k].squares(beta, b0)) / by[k].sw))
            trials.append(Trial(i, penalty, sum(scores) / len(scores), None, tuple(scores)))
        except DataError as e:
            trials.append(Trial(i, penalty, None, str(e)))
    return select(trials, True), trials


def trials_frame(df: DataFrame, trials: list[Trial]) -> DataFrame:
    """(index, penalty, fold, score) of ridge trials, as a frame."""
    rows = [(t.index, float(t.candidate), k, s) for t in trials for k, s in enumerate(t.folds)]
    return df.sparkSession.createDataFrame(rows, "index int, penalty double, fold int, score double")
