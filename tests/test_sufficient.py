"""Fits and scores from sums against separate fits, and how many jobs they take."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import encoders, metrics, ridge, scalers
from foldwise.operators.coordinates import View
from foldwise.operators.resampling import RollingPlan, k_fold, rolling_plan
from foldwise.operators.stages import Blueprint, Mapped, Named, Transform
from foldwise.plans import search, sufficient
from foldwise.plans.sufficient import Chain, rest, rolling_scores
from foldwise.sources.rows import DataError, Role, unsplit


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 2)) * [3.0, 0.2] + [50.0, -1.0]
    y = x @ [0.5, -4.0] + rng.normal(size=240)
    data = [(i, float(a), float(b), float(c), float(w), int(t), [float(a), float(b)]) for i, ((a, b), c, w, t) in enumerate(zip(x, y, rng.integers(0, 4, size=240), rng.integers(0, 60, size=240)))]
    df = spark.createDataFrame(data, "id long, x double, z double, y double, w double, t int, v array<double>").repartition(5).cache()
    return unsplit(df, "id", features=("x", "z"), target="y", weight="w", time="t")


def jobs(spark, f):
    group = f"count-{f.__name__}-{id(f)}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        out = f()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def slow(b, analysis, assessment, metric):
    fitted = b.fit(analysis.with_df(analysis.df.drop("fold", "pos"), role=Role.TRAIN), 5)
    return metric.evaluate(fitted.apply(assessment.df).withColumnRenamed("y", "truth").withColumnRenamed("w", "weight"))


BLUEPRINTS = {
    "ridge": lambda p: Blueprint().learn(ridge.Ridge(ridge.Config(p))),
    "standard": lambda p: Blueprint().via(scalers.StandardScaler()).learn(ridge.Ridge(ridge.Config(p))),
    "twice": lambda p: Blueprint().via(scalers.ScaleOnlyScaler()).via(scalers.StandardScaler()).learn(ridge.Ridge(ridge.Config(p, intercept=False, solver="cg"))),
    "mapped": lambda p: Blueprint().via(Mapped("more", {"x": F.col("x") + 1, "xz": F.col("x") * F.col("z"), "one": F.lit(1.0)})).via(scalers.StandardScaler()).learn(ridge.Ridge(ridge.Config(p, solver="lsqr"))),
    "weighted": lambda p: Blueprint().via(scalers.StandardScaler()).learn(ridge.Ridge(ridge.Config(p), weighted=True)),
}


@pytest.mark.parametrize("name", BLUEPRINTS)
def test_search_equals_separate_fits(spark, rows, name):
    plan = k_fold(rows, 4, 3)
    metric = metrics.weighted_rmse() if name == "weighted" else metrics.rmse()
    penalties = [0.01, 1.0, 300.0]
    best, trials = search.cross_validated(penalties, BLUEPRINTS[name], plan, metric, 5, "y")
    for p, t in zip(penalties, trials):
        for k, score in enumerate(t.folds):
            assert score == pytest.approx(slow(BLUEPRINTS[name](p), plan.analysis(k), plan.assessment(k), metric), rel=1e-8)
    assert best.objective == min(t.objective for t in trials)


def test_jobs_of_a_search_do_not_grow(spark, rows):
    few, many = k_fold(rows, 2, 3), k_fold(rows, 8, 3)

    def small():
        return search.cross_validated([1.0], BLUEPRINTS["standard"], few, metrics.rmse(), 5, "y")

    def large():
        return search.cross_validated([10.0**k for k in range(-3, 4)], BLUEPRINTS["standard"], many, metrics.rmse(), 5, "y")

    assert jobs(spark, small)[1] == jobs(spark, large)[1] > 0


def test_search_of_vectors_and_other_blueprints(spark, rows):
    plan = k_fold(rows, 3, 3)
    view = View.vector(rows.df, "v", size=2)
    vector = lambda p: Blueprint().via(scalers.StandardScaler(view=view)).learn(ridge.Ridge(ridge.Config(p), view=view))
    named = search.cross_validated([0.5, 50.0], BLUEPRINTS["standard"], plan, metrics.rmse(), 5, "y")[1]
    for a, b in zip(named, search.cross_validated([0.5, 50.0], vector, plan, metrics.rmse(), 5, "y")[1]):
        assert a.objective == pytest.approx(b.objective, rel=1e-10)

    class Half(Transform):
        def fit(self, rows, seed):
            return Named("half", 1, {"x": F.col("x") / 2, "z": F.col("z")})

    class Unfit(Transform):
        def fit(self, rows, seed):
            raise DataError("Unfit")

    choices = [BLUEPRINTS["ridge"](1.0), Blueprint().via(Half()).learn(ridge.Ridge(ridge.Config(1.0))), Blueprint().via(Unfit()).learn(ridge.Ridge(ridge.Config(1.0))), Blueprint().via(scalers.StandardScaler("reject")).via(Mapped("m", {"x": F.col("x")})).learn(ridge.Ridge(ridge.Config(1.0)))]
    assert [Chain.of(c) is None for c in choices] == [False, True, True, True]
    best, trials = search.cross_validated([0, 1, 2, 3], lambda i: choices[i], plan, metrics.rmse(), 5, "y")
    assert trials[2].error and "Unfit" in trials[2].error and all(t.error is None for t in trials if t.index != 2)
    constant = rows.with_df(rows.df.withColumn("z", F.lit(0.1)))
    best, trials = search.cross_validated(["emit-zero", "reject"], lambda c: Blueprint().via(scalers.StandardScaler(c)).learn(ridge.Ridge(ridge.Config(1.0))), k_fold(constant, 3, 3), metrics.rmse(), 5, "y")
    assert trials[0].error is None and "ConstantCoordinate" in trials[1].error and best.index == 0


@pytest.mark.parametrize("initial, assess, step", [(60, 20, 25), (50, 40, 15), (100, 30, 30), (100, 1, 20), (239, 5, 5)])
def test_rolling_equals_separate_fits(spark, rows, initial, assess, step):
    plan = rolling_plan(rows, initial, assess, step)
    found = rolling_scores(plan, BLUEPRINTS["standard"](2.0))
    assert [(o.fold, o.start, o.end) for o in found] == [(i, initial + i * step, min(initial + i * step + assess, 240)) for i in range(len(found))] and initial + len(found) * step >= 240
    for o in found[:: max(1, len(found) // 3)]:
        assert plan.analysis(o.fold).df.count() == o.start and plan.assessment(o.fold).df.count() == o.end - o.start
        assert o.score == pytest.approx(slow(BLUEPRINTS["standard"](2.0), plan.analysis(o.fold), plan.assessment(o.fold), metrics.rmse()), rel=1e-8)
    beta, b0 = found[-1].fit.raw()
    last = BLUEPRINTS["standard"](2.0).fit(plan.analysis(found[-1].fold).with_df(plan.analysis(found[-1].fold).df, role=Role.TRAIN), 1)
    first = plan.assessment(found[-1].fold).df.first()
    assert last.apply(plan.assessment(found[-1].fold).df.where(F.col("id") == first["id"])).first()["prediction"] == pytest.approx(b0 + beta @ [first["x"], first["z"]])


def test_rolling_takes_as_many_jobs_for_any_number_of_origins(spark, rows):
    few, many = rolling_plan(rows, 200, 20, 40), rolling_plan(rows, 20, 5, 5)

    def small():
        return rolling_scores(few, BLUEPRINTS["ridge"](1.0))

    def large():
        return rolling_scores(many, BLUEPRINTS["ridge"](1.0))

    (a, one), (b, two) = jobs(spark, small), jobs(spark, large)
    assert (len(a), len(b)) == (1, 44) and one == two > 0


def test_rolling_errors(spark, rows):
    plan = rolling_plan(rows, 200, 20, 40)
    with pytest.raises(DataError, match="NotSufficient"):
        rolling_scores(plan, Blueprint().via(encoders.CrossFitted("t")).learn(ridge.Ridge(ridge.Config(1.0))))
    with pytest.raises(DataError, match="InvalidFold"):
        plan.analysis(1)
    with pytest.raises(DataError, match="IncompletePlan"):
        encoders.out_of_fold(plan, "t", "e")
    with pytest.raises(DataError, match="ZeroTotalWeight"):
        rolling_scores(rolling_plan(rows.with_df(rows.df.withColumn("w", F.when(F.col("t") < 45, 1.0).otherwise(0.0))), 200, 20, 40), BLUEPRINTS["weighted"](1.0))


def test_rest():
    found = rest({"a": 1, "b": 20, "c": 300})
    assert found == {"a": 320, "b": 301, "c": 21} and math.isfinite(found["a"])


@pytest.mark.parametrize("name", ["standard", "weighted"])
@pytest.mark.parametrize("initial, assess, step", [(20, 20, 10), (30, 25, 7)])
def test_rolling_frame_adds_up_parts_of_blocks_in_tasks(spark, rows, monkeypatch, name, initial, assess, step):
    """Sums and fits of the origins aren't brought to the driver; parts, blocks cut by tasks and gaps in the blocks' numbers give what separate fits give."""
    monkeypatch.setattr(sufficient, "PARTS", 3)
    monkeypatch.setattr(sufficient, "AT_ONCE", 2)
    plan = rolling_plan(rows, initial, assess, step)
    monkeypatch.setattr(RollingPlan, "ranges", None)  # a list of all origins
    found = {r["fold"]: r for r in sufficient.rolling_frame(plan, BLUEPRINTS[name](2.0)).collect()}
    data = sorted(((r["pos"], r["x"], r["z"], r["y"], r["w"]) for r in plan.rows.df.collect()))
    x, y, w = np.array([r[1:3] for r in data]), np.array([r[3] for r in data]), np.array([r[4] for r in data])
    w = w if name == "weighted" else np.ones(240)
    assert sorted(found) == list(range(plan.folds))
    for i, r in found.items():
        start, end = initial + i * step, min(initial + i * step + assess, 240)
        assert (r["start"], r["end"]) == (start, end)
        z = (x - x[:start].mean(axis=0)) / x[:start].std(axis=0)
        mean, ym = np.average(z[:start], axis=0, weights=w[:start]), np.average(y[:start], weights=w[:start])
        c, v = z[:start] - mean, w[:start]
        beta = np.linalg.solve((c * v[:, None]).T @ c + 2 * np.eye(2), (c * v[:, None]).T @ (y[:start] - ym))
        off = y[start:end] - ym - (z[start:end] - mean) @ beta
        assert r["score"] == pytest.approx(math.sqrt(np.average(off**2, weights=w[start:end])), rel=1e-8)
