import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.operators import coordinates, encoders, metrics, ridge, scalers
from foldwise.operators.resampling import k_fold
from foldwise.operators.stages import Blueprint, MapError, Mapped, StageError
from foldwise.plans import search
from foldwise.plans.experiment import Authority, Experiment, ExperimentError, evaluate, phase_seed
from foldwise.sources import artifacts
from foldwise.sources.rows import DataError, Role, from_pairs

POINTS = [((0, 0), 1), ((1, 0), 3), ((0, 1), 0.5), ((1, 1), 2.5), ((2, -1), 5.5)]


def train(rows):
    return rows.with_df(rows.df, role=Role.TRAIN)


def points(spark, pairs=POINTS):
    return train(from_pairs(spark, pairs, ("x", "z")))


def many(spark, n=200):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 2))
    return from_pairs(spark, [((a, b), 2 * a - b + 1 + 0.1 * e) for (a, b), e in zip(x.tolist(), rng.normal(size=n).tolist())], ("x", "z"))


def test_scalers(spark):
    rows = train(from_pairs(spark, [((1, 4), 0), ((2, 4), 0), ((3, 4), 0)], ("x", "y")))
    got = scalers.StandardScaler().fit(rows).apply(rows.df).agg(F.avg("x"), F.var_pop("x"), F.max(F.abs("y"))).first()
    assert got[0] == pytest.approx(0) and got[1] == pytest.approx(1) and got[2] == 0
    with pytest.raises(DataError, match="ConstantCoordinate: y"):
        scalers.StandardScaler("reject").fit(rows)
    zeros = train(from_pairs(spark, [((0, 2), 0), ((3, 0), 0), ((6, 8), 0)], ("x", "y")))
    out = [tuple(r) for r in scalers.ScaleOnlyScaler().fit(zeros).apply(zeros.df).orderBy("row_id").select("x", "y").collect()]
    assert out[0][0] == 0 and out[1][1] == 0 and out[2][0] == pytest.approx(6 / math.sqrt(6))
    with pytest.raises(DataError, match="NotFitData"):
        scalers.StandardScaler().fit(zeros.with_df(zeros.df, role=Role.TEST))
    bad = train(from_pairs(spark, [((1, 1), 0), ((float("nan"), 1), 0)], ("x", "y")))
    with pytest.raises(DataError, match="NonFinite: row 1, x"):
        scalers.StandardScaler().fit(bad)
    tenth = train(from_pairs(spark, [((0.1, i), 0) for i in range(9)], ("x", "y")))
    assert scalers.inverse_deviations(scalers.moments(tenth.with_df(tenth.df.repartition(3))))[0] == 0.0


def test_coordinates(spark):
    df = spark.createDataFrame([(0, 1 << 53, 2.5), (1, (1 << 53) + 1, 2.5), (2, (1 << 63) - 1, 2.5), (3, -(1 << 63), 2.5)], "row_id long, a long, b double")
    assert [r[0] for r in df.orderBy("row_id").select(coordinates.exact_long("a")).collect()] == [True, False, False, True]
    from foldwise.sources.rows import unsplit

    assert coordinates.first_problem(unsplit(df, "row_id", features=("b", "a"))).first().asDict() == {"row_id": 1, "index": 1, "name": "a", "code": "LossyConversion"}
    values = spark.createDataFrame([(1.0,), (1.5,), (40000.0,), (float("nan"),), (None,)], "v double")
    assert [r[0] for r in values.select(coordinates.build(F.col("v"), T.ShortType())[1]).collect()] == [None, "InvalidIntegral", "OutOfRange", "OutOfRange", "Missing"]
    assert [r[0] for r in spark.createDataFrame([(0.5,), (0.1,), (1e300,)], "v double").select(coordinates.build(F.col("v"), T.FloatType())[1]).collect()] == [None, "LossyConversion", "OutOfRange"]
    with pytest.raises(DataError, match="UnsupportedFeatureType"):
        coordinates.check_schema(spark.createDataFrame([("a",)], "s string"), ("s",))


def test_ridge_exact_and_analytic(spark):
    m = ridge.Ridge(ridge.Config(0.0)).fit(points(spark))
    assert m.intercept == pytest.approx(1, abs=1e-10) and m.coefficients == pytest.approx((2, -0.5), abs=1e-10)
    flat = points(spark, [((1, 0), 2), ((2, 0), 4), ((3, 0), 5)])
    m = ridge.Ridge(ridge.Config(7.0, intercept=False)).fit(flat)
    assert m.coefficients == pytest.approx((25 / 21, 0), abs=1e-10) and m.intercept == 0
    got = m.explained(flat.df).orderBy("row_id").first()
    assert got["prediction"] == got["intercept"] + got["from_x"] + got["from_z"]


@pytest.mark.parametrize("pairs,penalty,tolerance", [(POINTS, 0.25, 2e-7), ([((i / 7, i / 7 * (1 + 1e-8 * (i % 3))), i + 0.5) for i in range(20)], 1e-3, 2e-5)])
def test_solvers_agree(spark, pairs, penalty, tolerance):
    rows = points(spark, pairs)
    got = [ridge.Ridge(ridge.Config(penalty, solver=s)).fit(rows) for s in ridge.SOLVERS]
    for m in got[1:]:
        assert m.coefficients == pytest.approx(got[0].coefficients, abs=tolerance, rel=tolerance)
        assert m.kkt < 1e-6


def test_ridge_errors(spark):
    for bad in (dict(penalty=-1), dict(penalty=float("nan")), dict(penalty=1, tolerance=0), dict(penalty=0, solver="cg"), dict(penalty=1, solver="none")):
        with pytest.raises(DataError):
            ridge.Config(**bad)
    rows = points(spark)
    with pytest.raises(DataError, match="NonFiniteTarget"):
        ridge.Ridge(ridge.Config(1.0)).fit(rows.with_df(rows.df.withColumn("target", F.lit(float("inf")))))
    with pytest.raises(DataError, match="NoWeight"):
        ridge.Ridge(ridge.Config(1.0), weighted=True).fit(rows)


def test_metrics(spark):
    scored = spark.createDataFrame([(2.0, 0.0, 1.0), (4.0, 0.0, 3.0)], "truth double, prediction double, weight double")
    assert metrics.weighted_rmse().evaluate(scored) == pytest.approx(math.sqrt(13))
    assert metrics.accuracy().evaluate(spark.createDataFrame([("cat", "cat"), ("cat", "dog"), ("dog", "dog")], "truth string, prediction string")) == pytest.approx(2 / 3)
    with pytest.raises(DataError, match="ZeroTotalWeight"):
        metrics.weighted_rmse().evaluate(scored.withColumn("weight", F.lit(0.0)))
    with pytest.raises(DataError, match="NegativeWeight"):
        metrics.weighted_rmse().evaluate(scored.withColumn("weight", -F.col("weight")))
    with pytest.raises(DataError, match="Empty"):
        metrics.rmse().evaluate(scored.limit(0))
    bad = spark.createDataFrame([(1.0, float("inf")), (float("nan"), 1.0), (float("inf"), 1.0)], "truth double, prediction double")
    assert metrics.first_problem(bad).first()["value"] == float("inf") and metrics.first_problem(bad).first()["kind"] == "NonFiniteTruth"


def test_exact_sum(spark):
    big = 1.7976931348623157e308
    for values in ([big, -big, 1.0, 2.0**-53], [1.0, 2.0**-53, -big, big], [5e-324, 5e-324], [0.1] * 10, [big / 3, -1e-300, -big / 3]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        for n in (1, 3):
            assert metrics.exact_sum(df.repartition(n), F.col("v")) == float(sum(map(Fraction, values)))
    assert metrics.exact_sum(df.limit(0), F.col("v")) == 0.0
    with pytest.raises(DataError):
        metrics.exact_sum(spark.createDataFrame([(float("inf"),)], "v double"), F.col("v"))


def test_raw_bits(spark):
    powers = [2.0**e for e in range(-1074, 1024)]
    near = [f(p) for p in powers[60::7] for f in (lambda p: np.nextafter(p, 0.0), lambda p: np.nextafter(p, np.inf))]
    drawn = [v for v in np.random.default_rng(5).integers(-(1 << 63), (1 << 63) - 1, 3000).view(np.float64).tolist() if v == v]
    values = [*powers, *map(float, near), *drawn, 0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf"), float("nan")]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", metrics.bits(F.col("v")), metrics.bits(-F.col("v"))).collect()
    for v, b, negative in got:
        if v != v:
            assert b == negative == 0x7FF8 << 48
        else:
            assert (b, negative) == (int(np.float64(v).view(np.int64)), int(np.float64(-v).view(np.int64)))
    assert spark.sql("SELECT cast(null AS double) AS v").select(metrics.bits(F.col("v"))).first()[0] is None


def test_isomorphic_views(spark):
    iso = coordinates.Isomorphic(coordinates.View(("price",)), {"price": F.col("cents") / 100.0}, {"cents": F.round(F.col("price") * 100).cast("long")})
    df = spark.createDataFrame([(1, 250), (2, 1), (3, None)], "id long, cents long")
    assert sorted(iso.read(df).collect()) == [(1, 2.5), (2, 0.01), (3, None)] and sorted(iso.build(iso.read(df)).collect()) == sorted(df.collect())
    assert iso.broken(df).count() == 0
    lossy = coordinates.Isomorphic(coordinates.View(("price",)), {"price": F.floor(F.col("cents") / 100.0).cast("double")}, iso.back)
    assert [r["id"] for r in lossy.broken(df).orderBy("id").collect()] == [1, 2]
    with pytest.raises(DataError, match="ClashingColumns"):
        iso.read(df.withColumn("price", F.lit(1)))
    with pytest.raises(DataError, match="InvalidFeatureNames"):
        coordinates.Isomorphic(coordinates.View(("price", "size")), iso.to, iso.back)


def test_renamed_failures(spark):
    from foldwise.sources.rows import unsplit

    df = spark.createDataFrame([(i, float(i), float(i % 3), 2.0 * i) for i in range(9)], "id long, x double, z double, y double")
    rows = train(unsplit(df, "id", features=("x", "z"), target="y"))
    codes = {"NonFiniteInput": "Unusable", "ConstantCoordinate": "Flat"}
    learner = ridge.Ridge(ridge.Config(0.1))
    plain, renamed = (Blueprint().via(t).learn(learner).fit(rows, 1) for t in (scalers.StandardScaler(), MapError(scalers.StandardScaler(), codes)))
    assert plain.audit.digest == renamed.audit.digest and sorted(plain.predict(rows).collect()) == sorted(renamed.predict(rows).collect())
    bad = rows.with_df(df.withColumn("x", F.when(F.col("id") == 4, float("nan")).when(F.col("id") == 2, 1.7e308).otherwise(F.col("x"))))
    assert {r["id"]: r["failure"]["code"] for r in renamed.checked(bad).where("failure is not null").collect()} == {4: "Unusable:x", 2: "NonFiniteOutput:prediction"}
    stage = renamed.stages[0].guarded(bad.df.withColumn("error", F.when(F.col("id") == 4, "Earlier")))
    assert {r["id"]: r["error"] for r in stage.where("error is not null").collect()} == {4: "Earlier"} and "_before" not in stage.columns
    with pytest.raises(StageError, match="stage 0: Flat: z") as e:
        Blueprint().via(MapError(scalers.StandardScaler(constant="reject"), codes)).learn(learner).fit(rows.with_df(df.withColumn("z", F.lit(1.0))), 1)
    assert e.value.code == "Flat"


def test_pairs_without_a_key(spark):
    from foldwise.sources.rows import paired

    df = spark.createDataFrame([(3, 1, "b"), (1, 2, "a"), (1, 2, "a"), (None, 5, None)], "a int, b int, c string")
    got = [[tuple(r) for r in paired(df.repartition(n), {"a": F.col("a"), "b": F.col("b")}, F.col("a") + F.col("b"), [F.col("a"), F.col("c")]).df.orderBy("row_id").collect()] for n in (1, 3)]
    assert got[0] == got[1] == [(0, None, 5.0, None), (1, 1.0, 2.0, 3.0), (2, 1.0, 2.0, 3.0), (3, 3.0, 1.0, 4.0)]
    assert paired(df.limit(0), {"a": F.col("a")}, F.col("b"), [F.col("a")]).df.count() == 0


def test_cross_fit_never_sees_own_fold(spark):
    rows = from_pairs(spark, [((i % 3, 0), 10.0 * i) for i in range(30)], ("x", "z"))
    plan = k_fold(rows, 5, 7)
    got = encoders.out_of_fold(plan, "x", "e").df.collect()
    for r in got:
        others = [q["target"] for q in got if q["x"] == r["x"] and q["fold"] != r["fold"]]
        assert r["e"] == pytest.approx(sum(others) / len(others))
    own = from_pairs(spark, [((i, 0), float(i)) for i in range(10)], ("x", "z"))
    for r in (got := encoders.out_of_fold(k_fold(own, 5), "x", "e").df.collect()):
        assert r["e"] == pytest.approx(np.mean([q["target"] for q in got if q["fold"] != r["fold"]]))
    fitted = Blueprint().via(encoders.CrossFitted("x", "e", 3, then=scalers.StandardScaler())).learn(ridge.Ridge(ridge.Config(1.0))).fit(train(rows), 1)
    assert fitted.predict(rows).count() == 30
    assert Blueprint().via(encoders.MeanTarget()).learn(ridge.Ridge(ridge.Config(1.0))).fit(train(rows), 1).predict(rows).count() == 30


def test_ridge_grid_equals_separate_fits(spark):
    rows = many(spark)
    plan = k_fold(rows, 4, 5)
    best, trials = search.ridge_grid(rows, plan, [0.01, 1.0, 100.0])
    slow_best, slow = search.cross_validated([0.01, 1.0, 100.0], lambda p: Blueprint().learn(ridge.Ridge(ridge.Config(p))), plan, metrics.rmse(), 5, "target")
    assert [t.objective for t in trials] == pytest.approx([t.objective for t in slow], rel=1e-9) and best.index == slow_best.index


def test_unlawful_blueprints(spark):
    learner = ridge.Ridge(ridge.Config(1.0))
    encoder = encoders.CrossFitted("x")
    fitted = Blueprint().learn(learner).fit(points(spark), 0)
    for bad in (lambda: Blueprint().via(encoder).via(scalers.StandardScaler()), lambda: Blueprint().via(encoder).via(encoder), lambda: Blueprint().learn(learner).learn(learner), lambda: Blueprint().learn(learner).via(encoder), lambda: Blueprint().via(fitted), lambda: Mapped("m", {"a": fitted.model}), lambda: Blueprint().via(encoder).fit(points(spark), 0), lambda: Blueprint().learn(encoder)):
        with pytest.raises(TypeError):
            bad()
    with pytest.raises(DataError, match="NotFitData"):
        Blueprint().learn(learner).fit(many(spark), 0)
    Blueprint().via(encoder).via(Mapped("twice", {"t": F.col("encoded") * 2}))


def test_seeds_follow_plan_and_ordinal(spark):
    b = Blueprint().via(scalers.StandardScaler()).via(Mapped("m", {"a": F.col("x") + F.col("z")})).learn(ridge.Ridge(ridge.Config(1.0)))
    one, two = b.fit(points(spark), 9).audit, b.fit(points(spark), 9).audit
    assert one == two and len({d["seed"] for d in one.details}) == 3 and one.digest == two.digest
    assert phase_seed(1, b.plan, "split") != phase_seed(1, b.plan, "test")


def test_routes(spark):
    b = Blueprint().via(scalers.StandardScaler()).learn(ridge.Ridge(ridge.Config(0.1)))
    rows = many(spark, 60)
    e = Experiment("train-validation-test", rows, b, metrics.rmse(), 21, 10, 12).run("deployment_refit")
    assert (e.validated.rows, e.tested.rows) == (10, 12) and e.validated.score < 0.5
    steps = Experiment("train-validation-test", rows, b, metrics.rmse(), 21, 10, 12)
    for name in Experiment.ROUTES["train-validation-test"]:
        steps.step(name)
    assert steps.tested.hash == e.tested.hash and steps.selection.hash == e.selection.hash
    with pytest.raises(DataError, match="RefitAlreadyTaken"):
        e.deployment.take()
    with pytest.raises(DataError, match="StepOutOfOrder"):
        e.step("test")
    p = Experiment("precommitted", rows, b, metrics.rmse(), 21, test=12)
    with pytest.raises(DataError, match="StepOutOfOrder"):
        p.step("test")
    assert p.run().tested.rows == 12 and p.selection is None
    with pytest.raises(ExperimentError) as x:
        Experiment("validation", rows, b, metrics.rmse(), 21, 60).run()
    assert x.value.phase == "partition" and x.value.cause.code == "ExhaustiveSplit"
    with pytest.raises(DataError, match="DuplicateObservedRow"):
        evaluate(e.candidate, e.split.train, e.split.train.with_df(e.split.train.df, role=Role.TEST), metrics.rmse(), "target")
    with pytest.raises(DataError, match="NotEvaluationData"):
        evaluate(e.candidate, e.split.train, e.split.train, metrics.rmse(), "target")
    assert Authority("x").take() == "x"


def test_artifacts(spark):
    b = Blueprint().via(scalers.StandardScaler()).learn(ridge.Ridge(ridge.Config(0.1)))
    f = b.fit(points(spark), 0)
    data = artifacts.encode(f)
    back = artifacts.decode(data)
    assert artifacts.encode(back) == data and back.audit.digest == f.audit.digest and back.audit.details == f.audit.details
    assert f.audit.details[0]["mean"] == pytest.approx([0.8, 0.2])
    assert back.predict(points(spark)).orderBy("row_id").collect() == f.predict(points(spark)).orderBy("row_id").collect()
    for bad, code in ((b"x", "Malformed"), (data.replace(b"0.1", b"0.2", 1), "WrongDigest"), (data + b"x", "Malformed")):
        with pytest.raises(DataError, match=code):
            artifacts.decode(bad)
    with pytest.raises(DataError, match="UnsupportedVersion"):
        artifacts.decode_stage({"format": "ridge", "version": 9, "payload": {}})


def test_guards(spark):
    df = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, 1e308)], "row_id long, x double")
    stage = scalers.Scaled(("x",), (0.0,), (10.0,))
    got = [r["error"] for r in stage.guarded(df).orderBy("row_id").collect()]
    assert got == [None, "NonFiniteInput:x", "NonFiniteOutput:x"]
    model = ridge.Model(("x",), (1.0,), 0.0)
    assert [r["error"] for r in model.guarded(stage.guarded(df)).orderBy("row_id").collect()][1:] == got[1:]


def test_predictions_fail_fast(spark):
    f = Blueprint().learn(ridge.Ridge(ridge.Config(0.1))).fit(points(spark), 0)
    bad = points(spark, [((0, 0), 1), ((float("nan"), 0), 3)])
    with pytest.raises(Exception, match="NonFinitePrediction: row 1"):
        f.predict(bad).collect()
    got = [r["prediction"] for r in f.predict(bad, check=False).orderBy("row_id").collect()]
    assert math.isfinite(got[0]) and math.isnan(got[1])
    assert f.predict(points(spark)).collect() == f.predict(points(spark), check=False).collect()
