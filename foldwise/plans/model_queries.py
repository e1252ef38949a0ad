"""Registered queries on coordinates, scalers, encoders, ridge models and metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.operators import coordinates, encoders, metrics, ridge, scalers
from foldwise.operators.coordinates import Isomorphic, View
from foldwise.operators.resampling import k_fold
from foldwise.operators.stages import Blueprint, MapError
from foldwise.operators.state import written
from foldwise.plans.tables import LINES, ORDER_FEATURES, finalize_sql, identity, lines, order_features, priced, read
from foldwise.sources.rows import Role, unsplit

SEED = 42
PENALTY = 0.1


def _train(rows):
    return rows.with_df(rows.df, role=Role.TRAIN)


def _parts(s, d):
    df = read(s, d, "part").select("p_partkey", "p_size", F.col("p_retailprice").cast("double").alias("p_retailprice"), F.lit(0.1).alias("constant"))
    return unsplit(df, "p_partkey", identity("part"), features=("p_size", "p_retailprice", "constant"), role=Role.TRAIN)


def scaler_moments(s, d):
    m = scalers.moments(_parts(s, d))
    return s.createDataFrame([(i, n, m.n, round(a, 6), round(v, 4)) for i, (n, a, v) in enumerate(zip(m.names, m.mean, m.variance))], "i int, name string, n long, mean double, variance double")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


def standardize(s, d):
    rows = _parts(s, d)
    return _rounded(scalers.StandardScaler().fit(rows).apply(rows.df), *rows.features)


def scale_only(s, d):
    rows = _parts(s, d)
    return _rounded(scalers.ScaleOnlyScaler().fit(rows).apply(rows.df), *rows.features)


def zero_variance_policy(s, d):
    rows = _parts(s, d)
    m = scalers.moments(rows)
    return s.createDataFrame([(n, low == high, round(v, 6)) for n, low, high, v in zip(m.names, m.low, m.high, scalers.inverse_deviations(m))], "name string, constant boolean, inverse double")


def inverse_transform(s, d):
    rows = _parts(s, d)
    stage = scalers.StandardScaler().fit(rows)
    return _rounded(stage.inverted(stage.apply(rows.df)), *rows.features)


def nonfinite_guard(s, d):
    df = read(s, d, "orders").select("o_orderkey", F.when(F.pmod("o_orderkey", F.lit(97)) == 0, float("nan")).otherwise(F.col("o_totalprice").cast("double")).alias("price"), F.when(F.pmod("o_orderkey", F.lit(89)) == 0, float("inf")).otherwise(1.0).alias("one"))
    stage = scalers.Scaled(("price", "one"), (0.0, 0.0), (1.0, 1.0))
    return stage.guarded(df).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def nonfinite_first(s, d):
    df = read(s, d, "orders").select("o_orderkey", F.when(F.pmod("o_orderkey", F.lit(97)) == 0, float("nan")).otherwise(F.col("o_totalprice").cast("double")).alias("price"), F.when(F.pmod("o_orderkey", F.lit(89)) == 0, float("inf")).otherwise(1.0).alias("one"))
    return coordinates.first_problem(unsplit(df, "o_orderkey", identity("orders"), features=("price", "one")))


def coordinates_long_exactness(s, d):
    x = F.col("o_orderkey")
    big = F.when(x % 4 == 0, x).when(x % 4 == 1, F.lit(1 << 53) + x).when(x % 4 == 2, F.lit((1 << 63) - 1) - x).otherwise(F.lit(-(1 << 62)) + x * 2)
    return read(s, d, "orders").select("o_orderkey", coordinates.exact_long(big).alias("exact"))


def coordinates_build(s, d):
    x = F.col("o_totalprice").cast("double")
    df = read(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.floor(x / 1000).cast("double")).when(F.col("o_orderkey") % 3 == 1, x).otherwise(F.floor(x).cast("double")).alias("v"))
    value, error = coordinates.build(F.col("v"), T.ShortType())
    return df.select("o_orderkey", value.cast("double").alias("value"), error.alias("error"))


def dense_schema_check(s, d):
    v = F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 10 == 1, F.concat("embedding", F.array(F.lit(float("nan")).cast("float")))).when(F.col("vec_id") % 10 == 2, F.lit(None)).when(F.col("vec_id") % 10 == 3, F.transform("embedding", lambda x, i: F.when(i > 0, x)))
    return coordinates.check_dense(read(s, d, "embeddings").select(v.otherwise(F.col("embedding")).alias("v")), "v", 64)


def _model(s, d, weighted=False, solver="cholesky"):
    rows = _train(lines(s, d))
    return rows, ridge.Ridge(ridge.Config(PENALTY, solver=solver), weighted).fit(rows)


def _coefficients(s, d, weighted=False):
    return _model(s, d, weighted)[1].table(read(s, d, "region")).withColumn("value", F.round("value", 4))


def ridge_solvers(s, d):
    """Largest relative difference of each solver's coefficients from the first one's, as a verdict."""
    rows = _train(priced(s, d))
    models = ridge.fits(rows, [ridge.Config(PENALTY, solver=k) for k in ridge.SOLVERS])
    return s.createDataFrame(_agreement(ridge.SOLVERS, models), "solver string, agrees boolean")


def _agreement(solvers, models):
    base = np.array(models[0].coefficients)
    return [(k, bool(np.abs(np.array(m.coefficients) / base - 1).max() < 2e-7)) for k, m in zip(solvers, models)]


#: Coordinates of the one-hot vector that `ridge_matrix_free` works on; few enough penalties to see them.
HOT, HOT_PENALTY = 500, 5.0


def ridge_matrix_free(s, d):
    """Orders' prices by a sparse one-hot vector of 500 groups of customers, solved over the rows: no 500 x 500 matrix is made, no zero is written."""
    k = F.pmod("o_custkey", F.lit(HOT)).cast("int")
    df = read(s, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"), F.struct(F.array(k).alias("indices"), F.array(F.lit(1.0)).alias("values")).alias("hot"))
    df = written(df.repartition(s.sparkContext.defaultParallelism))  # read once an iteration, by all cores
    rows = unsplit(df, "o_orderkey", identity("orders"), target="price", role=Role.TRAIN)
    view = View.of_sparse(df, "hot", HOT)
    m = ridge.Ridge(ridge.Config(HOT_PENALTY, solver="row-lsqr", tolerance=1e-12), view=view).fit(rows)
    return s.createDataFrame([(i, round(float(v), 2)) for i, v in enumerate((m.intercept, *m.coefficients), -1)], "position int, value double")


def _embedded(s, d, size=64):
    df = read(s, d, "embeddings").select("vec_id", F.slice("embedding", 1, size).alias("embedding"), F.col("label").cast("double").alias("label"))
    return unsplit(df, "vec_id", identity("embeddings"), target="label", role=Role.TRAIN), View.vector(df, "embedding", size=size)


def dense_gram(s, d):
    """Sums of products of all pairs of coordinates about their means."""
    rows, view = _embedded(s, d)
    g = ridge.Problem(rows, False, True, view).gram().centred(True)[0]
    return s.createDataFrame([(i, j, round(float(g[i, j]), 6)) for i in range(len(g)) for j in range(i, len(g))], "i int, j int, value double")


def dense_standardize(s, d):
    rows, view = _embedded(s, d)
    out = scalers.StandardScaler(view=view).fit(rows).apply(rows.df)
    return out.select("vec_id", F.posexplode("embedding").alias("position", "value")).withColumn("value", F.round("value", 6) + 0.0)


def dense_ridge(s, d):
    """The first two coordinates, scaled as a vector, then a ridge regression on the vector; predictions of all rows."""
    rows, view = _embedded(s, d, 2)
    fitted = Blueprint().via(scalers.StandardScaler(view=view)).learn(ridge.Ridge(ridge.Config(PENALTY), view=view)).fit(rows, SEED)
    return fitted.predict(rows).withColumn("prediction", F.round("prediction", 6) + 0.0)


def dense_solvers(s, d):
    """All six solvers on 64 coordinates; the Gram-based ones share a pass."""
    rows, view = _embedded(s, d)
    solvers = (*ridge.SOLVERS, *ridge.ROW_SOLVERS)
    return s.createDataFrame(_agreement(solvers, ridge.fits(rows, [ridge.Config(PENALTY, solver=k, tolerance=1e-12) for k in solvers], view=view)), "solver string, agrees boolean")


def view_descriptor(s, d):
    """Names and types of a view by position, as its descriptor has them, and whether taking a vector apart and together again gives the same vectors."""
    rows, view = _embedded(s, d, 3)
    apart = coordinates.named_columns(rows.df, view)
    again = coordinates.vectors(apart, View(view.names), ("vec_id",))
    same = again.join(rows.df, "vec_id").agg(F.bool_and(F.col("features") == F.col("embedding").cast("array<double>"))).first()[0]
    fields = View(view.names).descriptor(apart)["fields"]
    return s.createDataFrame([(i, n, kind, same) for i, (n, kind) in enumerate(fields)], "position int, name string, kind string, same boolean")


def raw_bits(s, d):
    """The bits of numbers of both signs."""
    v = F.col("o_totalprice").cast("double") / (F.col("o_orderkey") + 1) - 1000.0
    return read(s, d, "orders").select("o_orderkey", metrics.bits(v).alias("bits"))


def coordinates_imap(s, d):
    """The coordinates of another shape of row, and that shape built from them again."""
    cents = Isomorphic(
        View(("price", "size")),
        {"price": F.col("cents") / 100.0, "size": F.col("p_size").cast("double")},
        {"cents": F.round(F.col("price") * 100).cast("long"), "p_size": F.col("size").cast("int")},
    )
    df = read(s, d, "part").select("p_partkey", F.round(F.col("p_retailprice").cast("double") * 100).cast("long").alias("cents"), "p_size")
    seen = cents.read(df)
    again = cents.build(seen).select("p_partkey", "cents", F.col("p_size").cast("long").alias("p_size"))
    return seen.join(again, "p_partkey")


def failure_codes(s, d):
    """How many rows fail with which code when a scaler's own codes are given other names."""
    rows = _train(order_features(s, d))
    fitted = Blueprint().via(MapError(scalers.StandardScaler(), {"NonFiniteInput": "UnusableOrder"})).learn(ridge.Ridge(ridge.Config(PENALTY))).fit(rows, SEED)
    odd = rows.df.withColumn("quantity", F.when(F.col("o_orderkey") % 7 == 0, float("nan")).when(F.col("o_orderkey") % 7 == 1, 1.7e308).otherwise(F.col("quantity")))
    return fitted.checked(rows.with_df(odd)).groupBy("failure.code").agg(F.count(F.lit(1)).alias("n"))


def prices_equivalent(s, d):
    """Orders whose price is within a tolerance of their lines' prices less discount, with tax."""
    lines_ = read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("double")).alias("sum"))
    df = read(s, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price")).join(lines_, "o_orderkey")
    near = metrics.equivalent_columns(F.col("price"), F.col("sum"), 10_000.0, 0.25)
    return df.groupBy(near.alias("equivalent")).agg(F.count(F.lit(1)).alias("n"))


def ridge_predict(s, d):
    rows, m = _model(s, d)
    return m.apply(rows.df).select("row_id", F.round("prediction", 4).alias("prediction"))


def ridge_attribution(s, d):
    rows, m = _model(s, d)
    return m.explained(rows.df).select("row_id", *[F.round(c, 4).alias(c) for c in ("intercept", "from_l_quantity", "from_l_discount", "prediction")])


def ridge_evidence(s, d):
    rows, m = _model(s, d)
    n = rows.df.count()
    return s.createDataFrame([(round(m.objective / n, 2), bool(m.kkt < 1e-6 * m.objective))], "objective double, stationary boolean")


def _scored(s, d):
    """Truth: the line's price. Prediction: the price of as many pieces at 1,500 each."""
    return priced(s, d).df.select(F.col("l_extendedprice").alias("truth"), (F.col("l_quantity") * 1500.0).alias("prediction"), F.col("l_quantity").alias("weight"))


def _one(s, x):
    return s.createDataFrame([(round(x, 6),)], "value double")


def _labelled(s, d):
    docs = read(s, d, "documents").select("doc_id", "n_chars").join(read(s, d, "labels"), "doc_id")
    return docs.select(F.col("quality").alias("truth"), (F.col("n_chars") > 1000).cast("int").alias("prediction"), F.col("n_chars").cast("double").alias("weight"))


def metric_first_problem(s, d):
    k = F.col("o_orderkey")
    df = read(s, d, "orders").select(F.when(k % 50 == 7, float("inf")).otherwise(k.cast("double")).alias("truth"), F.when(k % 50 == 9, -float("inf")).otherwise(1.0).alias("prediction"), F.when(k % 50 == 11, -1.0 * k).otherwise(1.0).alias("weight"))
    some = metrics.first_problem(df, True).unionByName(metrics.first_problem(df.where("truth < 1e300 and prediction > -1e300"), True))
    return some.select("kind", F.col("value").cast("string").alias("value"))


def exact_sum(s, d):
    df = priced(s, d).df.select("l_extendedprice").unionByName(s.createDataFrame([(1.7976931348623157e308,), (-1.7976931348623157e308,)], "l_extendedprice double"))
    return _one(s, metrics.exact_sum(df, F.col("l_extendedprice")))


def rmse_by_fold(s, d):
    df = _scored(s, d).withColumn("fold", F.pmod(F.col("weight").cast("long"), F.lit(4)))
    return metrics.rmse().by(df, "fold").select("fold", F.round(F.sqrt(F.col("s") / F.col("_n")), 6).alias("value"))


def _cross_fit_rows(s, d):
    rows = order_features(s, d)
    plan = k_fold(rows.with_df(rows.df.select("o_orderkey", "o_totalprice", "o_orderpriority"), features=(), weight=None, group=None), 5, SEED)
    return plan, encoders.out_of_fold(plan, "o_orderpriority", "encoded")


def crossfit_target_mean(s, d):
    return _cross_fit_rows(s, d)[1].df.select("o_orderkey", "fold", F.round("encoded", 4).alias("encoded"))


def crossfit_then_scale(s, d):
    plan, encoded = _cross_fit_rows(s, d)
    return encoders.scale_in_folds(plan, encoded, "o_orderpriority", "encoded").df.select("o_orderkey", F.round("encoded", 6).alias("encoded"))


def crossfit_then_scale_only(s, d):
    plan, encoded = _cross_fit_rows(s, d)
    return encoders.then_in_folds(plan, encoded, "o_orderpriority", "encoded", scalers.ScaleOnlyScaler(), 0).df.select("o_orderkey", F.round("encoded", 6).alias("encoded"))


def fold_encoder_serving(s, d):
    rows = order_features(s, d)
    stage = encoders.serving_state(rows, "o_orderpriority", "encoded")
    new = s.createDataFrame([("1-URGENT",), ("5-LOW",), ("none of these",), (None,)], "o_orderpriority string")
    return stage.apply(new).select("o_orderpriority", F.round("encoded", 4).alias("encoded"))


QUERIES = {
    "scaler_moments": scaler_moments,
    "standardize": standardize,
    "scale_only": scale_only,
    "zero_variance_policy": zero_variance_policy,
    "inverse_transform": inverse_transform,
    "nonfinite_guard": nonfinite_guard,
    "nonfinite_first": nonfinite_first,
    "coordinates_long_exactness": coordinates_long_exactness,
    "coordinates_build": coordinates_build,
    "dense_schema_check": dense_schema_check,
    "ridge_coefficients": _coefficients,
    "weighted_ridge_coefficients": lambda s, d: _coefficients(s, d, True),
    "ridge_solvers": ridge_solvers,
    "ridge_matrix_free": ridge_matrix_free,
    "dense_gram": dense_gram,
    "dense_standardize": dense_standardize,
    "dense_ridge": dense_ridge,
    "dense_solvers": dense_solvers,
    "view_descriptor": view_descriptor,
    "prices_equivalent": prices_equivalent,
    "raw_bits": raw_bits,
    "coordinates_imap": coordinates_imap,
    "failure_codes": failure_codes,
    "ridge_predict": ridge_predict,
    "ridge_attribution": ridge_attribution,
    "ridge_evidence": ridge_evidence,
    "rmse": lambda s, d: _one(s, metrics.rmse().evaluate(_scored(s, d))),
    "exact_rmse": lambda s, d: _one(s, metrics.exact_rmse(_scored(s, d))),
    "weighted_rmse": lambda s, d: _one(s, metrics.weighted_rmse().evaluate(_scored(s, d))),
    "rmse_by_fold": rmse_by_fold,
    "accuracy": lambda s, d: _one(s, metrics.accuracy().evaluate(_labelled(s, d))),
    "weighted_accuracy": lambda s, d: _one(s, metrics.weighted_accuracy().evaluate(_labelled(s, d))),
    "metric_first_problem": metric_first_problem,
    "exact_sum": exact_sum,
    "crossfit_target_mean": crossfit_target_mean,
    "crossfit_then_scale": crossfit_then_scale,
    "crossfit_then_scale_only": crossfit_then_scale_only,
    "fold_encoder_serving": fold_encoder_serving,
}


def ridge_sql(source: str, x1: str, x2: str, y: str, w: str, penalty: float, name: str = "ridge") -> str:
    """CTEs that end in `name`: b0, b1, b2 of a ridge regression on two features, by Cramer's rule on the centred sums."""
    return f"""{name}_m AS (SELECT sum({w} * {x1}) / sum({w}) AS m1, sum({w} * {x2}) / sum({w}) AS m2, sum({w} * {y}) / sum({w}) AS my FROM {source}),
{name}_s AS (SELECT sum({w} * ({x1} - m1) * ({x1} - m1)) + {penalty} AS a, sum({w} * ({x1} - m1) * ({x2} - m2)) AS b, sum({w} * ({x2} - m2) * ({x2} - m2)) + {penalty} AS c,
  sum({w} * ({x1} - m1) * ({y} - my)) AS p, sum({w} * ({x2} - m2) * ({y} - my)) AS q, any_value(m1) AS m1, any_value(m2) AS m2, any_value(my) AS my FROM {source}, {name}_m),
{name}_b AS (SELECT (c * p - b * q) / (a * c - b * b) AS b1, (a * q - b * p) / (a * c - b * b) AS b2, m1, m2, my FROM {name}_s),
{name} AS (SELECT my - m1 * b1 - m2 * b2 AS b0, b1, b2 FROM {name}_b)"""


_L = LINES + ", k AS (SELECT row_id, CAST(l_quantity AS DOUBLE) AS x1, CAST(l_discount AS DOUBLE) AS x2, CAST(l_extendedprice AS DOUBLE) AS y FROM l)"
_P = "p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, CAST(p_retailprice AS DOUBLE) AS b FROM part), m AS (SELECT avg(a) AS ma, var_pop(a) AS va, avg(b) AS mb, var_pop(b) AS vb, count(*) AS n FROM p)"
_BAD = "b AS (SELECT o_orderkey, o_orderkey % 97 = 0 AS bad1, o_orderkey % 89 = 0 AS bad2 FROM orders)"
_FOLDS = f"""o AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS y, o_orderpriority AS c FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
{finalize_sql("o", f"xor(CAST(o_orderkey AS UBIGINT), {SEED}::UBIGINT)", "o_orderkey, y, c", "r")},
f AS (SELECT *, CAST((row_number() OVER (ORDER BY rank, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM r),
e AS (SELECT t.fold, c, avg(y) AS v, count(*) AS n FROM f, range(0, 5) t(fold) WHERE f.fold <> t.fold GROUP BY t.fold, c)"""


_E = "e AS (SELECT vec_id, p, CAST(embedding[p + 1] AS DOUBLE) AS v FROM embeddings, range(0, 64) t(p))"


def _coefficient_sql(w: str) -> str:
    return f"""WITH {_L}, {ridge_sql("k", "x1", "x2", "y", w, PENALTY)}
SELECT CAST(-1 AS INTEGER) AS position, 'intercept' AS name, round(b0, 4) AS value FROM ridge UNION ALL SELECT 0, 'l_quantity', round(b1, 4) FROM ridge UNION ALL SELECT 1, 'l_discount', round(b2, 4) FROM ridge"""


_SCORED = "(SELECT CAST(l_extendedprice AS DOUBLE) AS t, l_quantity * CAST(1500.0 AS DOUBLE) AS p, CAST(l_quantity AS DOUBLE) AS w FROM lineitem)"
_LABELLED = "(SELECT quality AS t, CAST(n_chars > 1000 AS INTEGER) AS p, CAST(n_chars AS DOUBLE) AS w FROM documents JOIN labels USING (doc_id))"

ORACLE = {
    "scaler_moments": f"WITH {_P} SELECT CAST(0 AS INTEGER) AS i, 'p_size' AS name, n, round(ma, 6) AS mean, round(va, 4) AS variance FROM m UNION ALL SELECT 1, 'p_retailprice', n, round(mb, 6), round(vb, 4) FROM m UNION ALL SELECT 2, 'constant', n, 0.1, 0.0 FROM m",
    "standardize": f"WITH {_P} SELECT p_partkey, round((a - ma) * (1 / sqrt(va)), 6) + 0.0 AS p_size, round((b - mb) * (1 / sqrt(vb)), 6) + 0.0 AS p_retailprice, CAST(0.0 AS DOUBLE) AS constant FROM p, m",
    "scale_only": f"WITH {_P} SELECT p_partkey, round(a * (1 / sqrt(va)), 6) AS p_size, round(b * (1 / sqrt(vb)), 6) AS p_retailprice, CAST(0.0 AS DOUBLE) AS constant FROM p, m",
    "zero_variance_policy": f"WITH {_P} SELECT 'p_size' AS name, false AS constant, round(1 / sqrt(va), 6) AS inverse FROM m UNION ALL SELECT 'p_retailprice', false, round(1 / sqrt(vb), 6) FROM m UNION ALL SELECT 'constant', true, 0.0",
    "inverse_transform": f"WITH {_P} SELECT p_partkey, round(a, 6) AS p_size, round(b, 6) AS p_retailprice, CAST(0.1 AS DOUBLE) AS constant FROM p",
    "nonfinite_guard": f"WITH {_BAD} SELECT CASE WHEN bad1 THEN 'NonFiniteInput:price' WHEN bad2 THEN 'NonFiniteInput:one' END AS error, count(*) AS n FROM b GROUP BY 1",
    "nonfinite_first": f"WITH {_BAD} SELECT o_orderkey AS row_id, CAST(CASE WHEN bad1 THEN 0 ELSE 1 END AS INTEGER) AS index, CASE WHEN bad1 THEN 'price' ELSE 'one' END AS name, 'NonFinite' AS code FROM b WHERE bad1 OR bad2 ORDER BY o_orderkey LIMIT 1",
    "coordinates_long_exactness": """WITH v AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS HUGEINT) WHEN 1 THEN CAST(9007199254740992 AS HUGEINT) + o_orderkey WHEN 2 THEN CAST(9223372036854775807 AS HUGEINT) - o_orderkey ELSE CAST(-4611686018427387904 AS HUGEINT) + o_orderkey * 2 END AS x FROM orders)
SELECT o_orderkey, CAST(CAST(x AS DOUBLE) AS HUGEINT) = x AS exact FROM v""",
    "coordinates_build": """WITH v AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN floor(CAST(o_totalprice AS DOUBLE) / 1000) WHEN 1 THEN CAST(o_totalprice AS DOUBLE) ELSE floor(CAST(o_totalprice AS DOUBLE)) END AS v FROM orders)
SELECT o_orderkey, CASE WHEN v <= 32767 AND floor(v) = v THEN v END AS value, CASE WHEN v > 32767 THEN 'OutOfRange' WHEN floor(v) <> v THEN 'InvalidIntegral' END AS error FROM v""",
    "dense_schema_check": "SELECT code, count(*) AS n FROM (SELECT CASE vec_id % 10 WHEN 0 THEN 'DimensionMismatch' WHEN 1 THEN 'DimensionMismatch' WHEN 2 THEN 'Missing' WHEN 3 THEN 'NonFinite' END AS code FROM embeddings) WHERE code IS NOT NULL GROUP BY code",
    "ridge_coefficients": _coefficient_sql("1.0"),
    "weighted_ridge_coefficients": _coefficient_sql("x1"),
    "ridge_solvers": "SELECT solver, true AS agrees FROM (VALUES ('cholesky'), ('qr'), ('lsqr'), ('cg')) t(solver)",
    "ridge_matrix_free": f"""WITH g AS (SELECT o_custkey % {HOT} AS k, count(*) AS n, avg(CAST(o_totalprice AS DOUBLE)) AS y FROM orders GROUP BY 1),
b AS (SELECT sum(n * {HOT_PENALTY} / (n + {HOT_PENALTY}) * y) / sum(n * {HOT_PENALTY} / (n + {HOT_PENALTY})) AS b0 FROM g)
SELECT CAST(-1 AS INTEGER) AS position, round(b0, 2) AS value FROM b UNION ALL
SELECT CAST(p AS INTEGER), round(coalesce(n * (y - b0) / (n + {HOT_PENALTY}), 0), 2) + 0.0 FROM b, range(0, {HOT}) t(p) LEFT JOIN g ON g.k = p""",
    "dense_gram": f"""WITH {_E}, m AS (SELECT p, avg(v) AS m FROM e GROUP BY p), c AS (SELECT vec_id, e.p, v - m AS v FROM e JOIN m ON e.p = m.p)
SELECT CAST(a.p AS INTEGER) AS i, CAST(b.p AS INTEGER) AS j, round(sum(a.v * b.v), 6) AS value FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.p <= b.p GROUP BY a.p, b.p""",
    "dense_standardize": f"WITH {_E}, m AS (SELECT p, avg(v) AS m, 1 / sqrt(var_pop(v)) AS s FROM e GROUP BY p) SELECT vec_id, CAST(e.p AS INTEGER) AS position, round((v - m) * s, 6) + 0.0 AS value FROM e JOIN m ON e.p = m.p",
    "dense_ridge": f"""WITH x AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(label AS DOUBLE) AS y FROM embeddings), m AS (SELECT avg(a) AS ma, 1 / sqrt(var_pop(a)) AS sa, avg(b) AS mb, 1 / sqrt(var_pop(b)) AS sb FROM x),
k AS (SELECT vec_id, (a - ma) * sa AS x1, (b - mb) * sb AS x2, y FROM x, m), {ridge_sql("k", "x1", "x2", "y", "1.0", PENALTY)} SELECT vec_id, round(b0 + x1 * b1 + x2 * b2, 6) + 0.0 AS prediction FROM k, ridge""",
    "dense_solvers": "SELECT solver, true AS agrees FROM (VALUES ('cholesky'), ('qr'), ('lsqr'), ('cg'), ('row-lsqr'), ('row-cg')) t(solver)",
    "view_descriptor": "SELECT CAST(p AS INTEGER) AS position, 'embedding[' || p || ']' AS name, 'double' AS kind, true AS same FROM range(0, 3) t(p)",
    "raw_bits": "SELECT o_orderkey, CAST(CAST(CAST(o_totalprice AS DOUBLE) / CAST(o_orderkey + 1 AS DOUBLE) - 1000.0::DOUBLE AS BIT) AS BIGINT) AS bits FROM orders",
    "coordinates_imap": "SELECT p_partkey, round(CAST(p_retailprice AS DOUBLE) * 100) / 100.0::DOUBLE AS price, CAST(p_size AS DOUBLE) AS size, CAST(round(CAST(p_retailprice AS DOUBLE) * 100) AS BIGINT) AS cents, CAST(p_size AS BIGINT) AS p_size FROM part",
    "failure_codes": "SELECT CASE o_orderkey % 7 WHEN 0 THEN 'UnusableOrder:quantity' WHEN 1 THEN 'NonFiniteOutput:prediction' END AS code, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1",
    "prices_equivalent": "SELECT abs(p - s) <= greatest(10000.0, 0.25 * greatest(abs(p), abs(s))) AS equivalent, count(*) AS n FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS p FROM orders) JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DOUBLE)) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1",
    "ridge_predict": f"WITH {_L}, {ridge_sql('k', 'x1', 'x2', 'y', '1.0', PENALTY)} SELECT row_id, round(b0 + x1 * b1 + x2 * b2, 4) AS prediction FROM k, ridge",
    "ridge_attribution": f"WITH {_L}, {ridge_sql('k', 'x1', 'x2', 'y', '1.0', PENALTY)} SELECT row_id, round(b0, 4) AS intercept, round(x1 * b1, 4) AS from_l_quantity, round(x2 * b2, 4) AS from_l_discount, round(b0 + x1 * b1 + x2 * b2, 4) AS prediction FROM k, ridge",
    "ridge_evidence": f"WITH {_L}, {ridge_sql('k', 'x1', 'x2', 'y', '1.0', PENALTY)} SELECT round((sum((b0 + x1 * b1 + x2 * b2 - y) ** 2) + {PENALTY} * (any_value(b1) ** 2 + any_value(b2) ** 2)) / count(*), 2) AS objective, true AS stationary FROM k, ridge",
    "rmse": f"SELECT round(sqrt(avg((t - p) * (t - p))), 6) AS value FROM {_SCORED}",
    "exact_rmse": f"SELECT round(sqrt(avg((t - p) * (t - p))), 6) AS value FROM {_SCORED}",
    "weighted_rmse": f"SELECT round(sqrt(sum(w * (t - p) * (t - p)) / sum(w)), 6) AS value FROM {_SCORED}",
    "rmse_by_fold": f"SELECT CAST(w AS BIGINT) % 4 AS fold, round(sqrt(avg((t - p) * (t - p))), 6) AS value FROM {_SCORED} GROUP BY 1",
    "accuracy": f"SELECT round(avg(CAST(t = p AS DOUBLE)), 6) AS value FROM {_LABELLED}",
    "weighted_accuracy": f"SELECT round(sum(CASE WHEN t = p THEN w ELSE 0 END) / sum(w), 6) AS value FROM {_LABELLED}",
    "metric_first_problem": "SELECT 'NonFiniteTruth' AS kind, 'Infinity' AS value UNION ALL SELECT 'NegativeWeight', CAST(CAST(-min(o_orderkey) AS DOUBLE) AS VARCHAR) FROM orders WHERE o_orderkey % 50 = 11",
    "exact_sum": "SELECT round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE), 6) AS value FROM lineitem",
    "crossfit_target_mean": f"WITH {_FOLDS} SELECT o_orderkey, f.fold, round(v, 4) AS encoded FROM f JOIN e ON f.fold = e.fold AND f.c = e.c",
    "crossfit_then_scale": f"WITH {_FOLDS}, u AS (SELECT fold, sum(n * v) / sum(n) AS m, sum(n * v * v) / sum(n) AS q FROM e GROUP BY fold), g AS (SELECT e.fold, any_value(m) AS m, sqrt(sum(n * (v - m) * (v - m)) / sum(n)) AS d FROM e JOIN u ON e.fold = u.fold GROUP BY e.fold) SELECT o_orderkey, round((v - m) / d, 6) AS encoded FROM f JOIN e ON f.fold = e.fold AND f.c = e.c JOIN g ON f.fold = g.fold",
    "crossfit_then_scale_only": f"WITH {_FOLDS}, u AS (SELECT fold, sum(n * v) / sum(n) AS m, sum(n * v * v) / sum(n) AS q FROM e GROUP BY fold), g AS (SELECT e.fold, any_value(m) AS m, sqrt(sum(n * (v - m) * (v - m)) / sum(n)) AS d FROM e JOIN u ON e.fold = u.fold GROUP BY e.fold) SELECT o_orderkey, round(v / d, 6) AS encoded FROM f JOIN e ON f.fold = e.fold AND f.c = e.c JOIN g ON f.fold = g.fold",
    "fold_encoder_serving": f"WITH {ORDER_FEATURES}, m AS (SELECT o_orderpriority AS c, avg(y) AS v FROM f GROUP BY 1) SELECT t.c AS o_orderpriority, round(coalesce(m.v, (SELECT avg(y) FROM f)), 4) AS encoded FROM (VALUES ('1-URGENT'), ('5-LOW'), ('none of these'), (NULL)) t(c) LEFT JOIN m ON t.c = m.c",
}

