"""Vector columns, blocked exact sums, tree folds and solvers over rows."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.functions import tiles
from foldwise.operators import coordinates, metrics, ridge, scalers
from foldwise.operators.coordinates import FeatureSchema, View
from foldwise.operators.stages import Blueprint
from foldwise.operators.tree import tree_fold
from foldwise.sources import artifacts
from foldwise.sources.rows import DataError, Role, unsplit


def table(spark, n=300, d=6, seed=1, noise=0.1, collinear=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * 10.0 ** rng.integers(-2, 3, size=d) + rng.normal(size=d) * 100
    if collinear:
        x[:, 1] = x[:, 0] * (1 + 1e-8 * (np.arange(n) % 3))
    y = x @ rng.normal(size=d) + 3 + noise * rng.normal(size=n)
    w = rng.uniform(0.1, 4, size=n)
    w[::7] = 0.0
    df = spark.createDataFrame([(i, a.tolist(), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, w))], "id long, v array<double>, y double, w double")
    rows = unsplit(df, "id", target="y", weight="w", role=Role.TRAIN)
    return x, y, w, rows, View.vector(df, "v", size=d)


def exact(x, y, w, penalty, intercept):
    mean, ym = (w @ x / w.sum(), w @ y / w.sum()) if intercept else (0 * x[0], 0.0)
    a, b = x - mean, y - ym
    beta = np.linalg.solve((a * w[:, None]).T @ a + penalty * np.eye(x.shape[1]), (a * w[:, None]).T @ b)
    return beta, ym - mean @ beta if intercept else 0.0


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("intercept", [True, False])
def test_solvers_of_vectors(spark, weighted, intercept):
    x, y, w, rows, view = table(spark)
    beta, b0 = exact(x, y, w if weighted else np.ones(len(y)), 0.7, intercept)
    solvers = (*ridge.SOLVERS, *ridge.ROW_SOLVERS)
    models = ridge.fits(rows, [ridge.Config(0.7, intercept, 1e-13, k) for k in solvers], weighted, view)
    for k, m in zip(solvers, models):
        assert np.allclose(m.coefficients, beta, rtol=2e-7, atol=2e-7), k
        assert m.intercept == pytest.approx(b0, rel=1e-5, abs=1e-5) and m.receipt.assumptions
    passes = {k: m.receipt.passes for k, m in zip(solvers, models)}
    assert passes["cholesky"] == 1 and passes["lsqr"] == passes["cg"] == 0 and 1 < passes["row-lsqr"] < 60
    named = ridge.fits(rows.with_df(coordinates.named_columns(rows.df, view), features=view.names), [ridge.Config(0.7, intercept)], weighted)[0]
    assert named.coefficients == models[0].coefficients and named.intercept == models[0].intercept


def test_row_solvers_on_hard_rows(spark):
    x, y, w, rows, view = table(spark, collinear=True, noise=1.0)
    base, lsqr = ridge.fits(rows, [ridge.Config(1e-3, solver=k, tolerance=1e-13, iterations=400) for k in ("qr", "row-lsqr")], view=view)
    assert np.allclose(np.sum(base.coefficients[:2]), np.sum(lsqr.coefficients[:2]), rtol=2e-5) and np.allclose(base.coefficients[2:], lsqr.coefficients[2:], rtol=2e-5, atol=2e-5)
    few = ridge.Ridge(ridge.Config(0.5, solver="row-lsqr", iterations=1), view=view).fit(rows)
    assert few.receipt.termination == "iteration-limit" and few.receipt.iterations == 1
    ols = ridge.Ridge(ridge.Config(0.0, solver="row-lsqr", tolerance=1e-14), view=View.vector(rows.df, "v", size=6))
    flat = rows.with_df(rows.df.withColumn("y", F.lit(5.0)))
    assert ols.fit(flat).intercept == pytest.approx(5.0) and max(map(abs, ols.fit(flat).coefficients)) == 0.0


def test_sums_are_the_same_for_every_partitioning(spark):
    _, _, _, rows, view = table(spark, 500, 5)
    found = []
    for n in (1, 3, 7):
        df = rows.df.orderBy(F.xxhash64("id", F.lit(n))).repartition(n)
        model = ridge.Ridge(ridge.Config(0.3), True, view).fit(rows.with_df(df))
        found.append((model.coefficients, model.intercept, scalers.vector_moments(rows.with_df(df), view)))
    assert found[0] == found[1] == found[2]


def test_moments_of_vectors(spark):
    x, _, _, rows, view = table(spark, 400, 9)
    m = scalers.vector_moments(rows, view)
    assert np.allclose(m.mean, x.mean(axis=0), rtol=1e-14) and np.allclose(m.variance, x.var(axis=0), rtol=1e-12)
    named = scalers.moments(rows.with_df(coordinates.named_columns(rows.df, view), features=view.names))
    assert np.allclose(named.mean, m.mean, rtol=1e-15) and np.allclose(named.variance, m.variance, rtol=1e-13)
    stage = scalers.StandardScaler(view=view).fit(rows)
    z = np.array([r[0] for r in stage.apply(rows.df).orderBy("id").select("v").collect()])
    assert np.allclose(z, (x - x.mean(axis=0)) / x.std(axis=0), atol=1e-9)
    constant = rows.with_df(rows.df.withColumn("v", F.transform("v", lambda e, i: F.when(i == 2, 0.1).otherwise(e))))
    assert scalers.StandardScaler(view=view).fit(constant).inverse[2] == 0.0
    with pytest.raises(DataError, match=r"ConstantCoordinate: v\[2\]"):
        scalers.StandardScaler("reject", view).fit(constant)
    only = scalers.ScaleOnlyScaler(view=view).fit(rows)
    assert only.mean is None and only.inverse == stage.inverse


def test_many_coordinates_are_quick(spark):
    x, y, w, rows, view = table(spark, 2000, 64, noise=5.0)
    ridge.Ridge(ridge.Config(1.0), view=view).fit(rows)
    start = time.perf_counter()
    m = ridge.Ridge(ridge.Config(1.0), view=view).fit(rows)
    took = time.perf_counter() - start
    assert np.allclose(m.coefficients, exact(x, y, np.ones(len(y)), 1.0, True)[0], rtol=1e-6, atol=1e-6)
    assert took < 15  # some seconds on a free machine


def test_blueprint_of_vectors(spark):
    _, _, _, rows, view = table(spark)
    fitted = Blueprint().via(scalers.StandardScaler(view=view)).learn(ridge.Ridge(ridge.Config(0.1), view=view)).fit(rows, 3)
    back = artifacts.decode(artifacts.encode(fitted))
    assert back.predict(rows).orderBy("id").collect() == fitted.predict(rows).orderBy("id").collect()
    r = fitted.model.explained(fitted.stages[0].apply(rows.df)).first()
    assert r["intercept"] + sum(r["contributions"]) == pytest.approx(r["prediction"])
    assert fitted.model.guarded(fitted.stages[0].apply(rows.df)).where("error is not null").count() == 0


def test_bad_vectors(spark):
    _, _, _, rows, view = table(spark, 50, 3)
    bad = lambda e: rows.with_df(rows.df.withColumn("v", F.when(F.col("id") >= 20, e).otherwise(F.col("v"))).repartition(5))
    for e, code in ((F.lit(None), "Missing"), (F.slice("v", 1, 2), "DimensionMismatch"), (F.transform("v", lambda x, i: F.when(i == 1, float("nan")).otherwise(x)), "NonFinite"), (F.transform("v", lambda x, i: F.when(i != 1, x)), "NonFinite")):
        with pytest.raises(DataError, match=f"{code}: row 20"):
            scalers.vector_moments(bad(e), view)
        with pytest.raises(DataError, match=f"{code}: row 20"):
            ridge.Ridge(ridge.Config(1.0), view=view).fit(bad(e))
    with pytest.raises(DataError, match="EmptyData"):
        scalers.vector_moments(rows.with_df(rows.df.limit(0)), view)
    with pytest.raises(DataError, match="NegativeWeight"):
        ridge.Ridge(ridge.Config(1.0), True, view).fit(rows.with_df(rows.df.withColumn("w", -F.col("w") - 1)))
    with pytest.raises(DataError, match="ZeroTotalWeight"):
        ridge.Ridge(ridge.Config(1.0), True, view).fit(rows.with_df(rows.df.withColumn("w", F.lit(0.0))))


def test_schemas_and_views(spark):
    for names in ((), ("a", "a"), ("a", " ")):
        with pytest.raises(DataError):
            FeatureSchema(names)
    assert FeatureSchema(("a", "bc")).digest != FeatureSchema(("ab", "c")).digest
    df = spark.createDataFrame([(1, 2.0, "x", [1.0])], "id long, a double, s string, v array<double>")
    for column in ("a", "s"):
        with pytest.raises(DataError, match="UnsupportedFeatureType"):
            View.vector(df, column, size=1)
    view = View.vector(df, "v", FeatureSchema(("first",)))
    assert view.descriptor(df) == {"column": "v", "type": "array<double>", "size": 1, "digest": FeatureSchema(("first",)).digest}
    assert View(("id", "a")).descriptor(df)["fields"] == [["id", "bigint"], ["a", "double"]]
    assert coordinates.named_columns(df, view).first()["first"] == 1.0 and coordinates.vectors(df, View(("id", "a"))).first()["features"] == [1.0, 2.0]
    assert metrics.equivalent(1.0, 1.1, 0.2, 0) and not metrics.equivalent(1.0, 1.3, 0.2, 0.1) and metrics.equivalent(100.0, 109.0, 0, 0.1)


def test_own_backend(spark):
    class Zero(ridge.Backend):
        name = "zero"

        def solve(self, problem, config):
            return ridge.finished(np.zeros(problem.d), problem.at.x, problem.gram().y_centre, config, ridge.Receipt("zero", 0, "none", 0.0))

    with pytest.raises(DataError, match="UnknownSolver"):
        ridge.Config(1.0, solver="zero")
    ridge.register_backend(Zero())
    try:
        _, y, _, rows, view = table(spark)
        assert ridge.Ridge(ridge.Config(1.0, solver="zero"), view=view).fit(rows).intercept == pytest.approx(y.mean())
        with pytest.raises(DataError, match="BackendExists"):
            ridge.register_backend(Zero())
    finally:
        del ridge.BACKENDS["zero"]
    with pytest.raises(DataError, match="PenaltyRequired"):
        ridge.Config(0.0, solver="row-cg")


def test_tree_fold(spark):
    step = lambda batches: (lambda n: {None: {"n": np.array([n])}} if n else {})(sum(map(len, batches)))
    assert tree_fold(spark.range(1000).repartition(40), step)[None]["n"][0] == 1000
    assert tree_fold(spark.range(0), step) == {}


def test_exact_products():
    rng = np.random.default_rng(5)
    m = rng.normal(size=(1000, 4)) * [1e-8, 1, 1e9, 1e150]
    e = tiles.exponents(np.abs(m).max(axis=0))
    got = tiles.total(tiles.products(m, m, e, e), e[:, None] + e[None, :], 2 * tiles.BITS)
    assert np.allclose(got, m.T @ m, rtol=1e-12) and (got == got.T).all()
    a, b = tiles.products(m[:300], m[:300], e, e), tiles.products(m[300:], m[300:], e, e)
    assert (tiles.total({k: a[k] + b[k] for k in a}, e[:, None] + e[None, :], 2 * tiles.BITS) == got).all()
    assert math.isinf(tiles._scaled(1 << 40, 2000))


def test_sparse_view_equals_dense(spark):
    rng = np.random.default_rng(21)
    x = np.where(rng.random((300, 7)) < 0.3, rng.normal(size=(300, 7)) + 2.0, 0.0)
    y, w = x @ np.arange(7.0) + rng.normal(size=300), rng.random(300) + 0.5
    data = [(i, float(y[i]), float(w[i]), x[i].tolist(), (np.flatnonzero(x[i]).tolist(), x[i][x[i] != 0].tolist())) for i in range(300)]
    df = spark.createDataFrame(data, "id long, y double, w double, v array<double>, s struct<indices:array<int>,values:array<double>>").repartition(5)
    rows = unsplit(df, "id", target="y", weight="w", role=Role.TRAIN)
    dense, sparse = View.vector(df, "v", size=7), View.of_sparse(df, "s", 7)
    for solver in (*ridge.SOLVERS, *ridge.ROW_SOLVERS):
        a, b = (ridge.Ridge(ridge.Config(0.3, solver=solver, tolerance=1e-13), True, view).fit(rows) for view in (dense, sparse))
        assert np.allclose(a.coefficients, b.coefficients, rtol=1e-8) and a.objective == pytest.approx(b.objective) and b.kkt < 1e-6
    got = b.apply(df).select("id", "prediction").toPandas().sort_values("id")["prediction"].to_numpy()
    assert np.allclose(got, b.intercept + x @ np.array(b.coefficients))
    for bad, code in (("null", "Missing"), ("named_struct('indices', array(1), 'values', array(1D, 2D))", "DimensionMismatch"), ("named_struct('indices', array(2, 2), 'values', array(1D, 2D))", "InvalidIndex"), ("named_struct('indices', array(7), 'values', array(1D))", "InvalidIndex"), ("named_struct('indices', array(0, int(null)), 'values', array(1D, 2D))", "InvalidIndex"), ("named_struct('indices', array(3), 'values', array(double('NaN')))", "NonFinite")):
        broken = df.withColumn("s", F.expr(f"if(id = 9, {bad}, s)"))
        with pytest.raises(DataError, match=f"{code}.*row 9"):
            ridge.Ridge(ridge.Config(0.3, solver="row-lsqr"), view=sparse).fit(rows.with_df(broken))
    with pytest.raises(DataError, match="UnsupportedFeatureType"):
        scalers.StandardScaler(view=sparse).fit(rows)


def test_a_fold_is_one_job(spark):
    """Its first tasks run side by side: a local iterator over their partitions ran them one after another, a job each."""
    df, sc = spark.range(40).repartition(8), spark.sparkContext
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    sc.setJobGroup("one-fold", "counted")
    try:
        got = tree_fold(df, lambda batches: {None: {"n": np.array([sum(len(b) for b in batches)])}})
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert got[None]["n"].tolist() == [40] and len(sc.statusTracker().getJobIdsForGroup("one-fold")) == 1
