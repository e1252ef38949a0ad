"""Registered queries on searches, experiments, artifacts, receipts and streams."""

from __future__ import annotations

import uuid
from fractions import Fraction
from functools import reduce

from pyspark.sql import functions as F

from foldwise.functions.hashing import GAMMA, fnv1a
from foldwise.operators import metrics, ridge, scalers
from foldwise.operators.encoders import CrossFitted
from foldwise.operators.resampling import k_fold, rolling_plan
from foldwise.operators.stages import Blueprint, Mapped, child_seed
from foldwise.operators.state import shared_folder
from foldwise.plans import search
from foldwise.plans.experiment import Experiment, phase_seed
from foldwise.plans.model_queries import ridge_sql
from foldwise.plans.sufficient import rolling_frame
from foldwise.plans.tables import LINES, ORDER_FEATURES, WORD, finalize_sql, identity, lines, order_features, priced, rank_sql, read
from foldwise.sources import artifacts
from foldwise.sources.rows import Role, unsplit
from foldwise.streaming import metrics as stream_metrics
from foldwise.streaming.scoring import score_folder

SEED, PENALTY, PENALTIES = 42, 0.1, [0.01, 1.0, 100.0, 10000.0]


def blueprint(penalty: float = PENALTY) -> Blueprint:
    return Blueprint().via(scalers.StandardScaler()).learn(ridge.Ridge(ridge.Config(penalty)))


def experiment(s, d, route: str) -> Experiment:
    v, t = {"validation": (Fraction(1, 5), None), "train-validation-test": (Fraction(1, 5), Fraction(1, 10)), "precommitted": (None, Fraction(1, 10))}[route]
    return Experiment(route, order_features(s, d), blueprint(), metrics.rmse(), SEED, v, t)


def _scored(e):
    return e.scored.select("o_orderkey", F.round("truth", 4).alias("truth"), F.round("prediction", 4).alias("prediction"))


def experiment_score(s, d):
    e = experiment(s, d, "validation").run()
    return s.createDataFrame([(e.validated.rows, round(e.validated.score, 4))], "n long, score double")


def _model(s, model):
    return s.createDataFrame([(-1, "intercept", round(model.intercept, 4)), *((i, n, round(b, 4)) for i, (n, b) in enumerate(zip(model.features, model.coefficients)))], "position int, name string, value double")


def cv_ridge_grid(s, d):
    rows = lines(s, d)
    plan = k_fold(rows, 5, SEED)
    return search.trials_frame(rows.df, search.ridge_grid(rows, plan, PENALTIES)[1]).withColumn("score", F.round("score", 4))


def cv_ridge_best(s, d):
    rows = lines(s, d)
    best, trials = search.ridge_grid(rows, k_fold(rows, 5, SEED), PENALTIES)
    return s.createDataFrame([(best.index, best.candidate, round(best.objective, 4))], "index int, penalty double, score double")


def cv_any_blueprint(s, d):
    """The general search, a fit for each fold: mean RMSE of two penalties over three folds."""
    rows = order_features(s, d)
    plan = k_fold(rows, 3, SEED)
    trials = search.cross_validated([0.1, 1000.0], lambda p: Blueprint().learn(ridge.Ridge(ridge.Config(p))), plan, metrics.rmse(), SEED, "o_totalprice")[1]
    return s.createDataFrame([(t.index, t.candidate, round(t.objective, 4)) for t in trials], "index int, penalty double, score double")


def _events(s, d):
    """Events in time order: the value by the user's number and the count in the properties."""
    df = read(s, d, "events").select("event_id", "ts", F.col("user_id").cast("double").alias("user"), F.get_json_object("props", "$.k").cast("double").alias("k"), F.col("value").cast("double").alias("value"))
    return unsplit(df, "event_id", identity("events"), features=("user", "k"), target="value", time="ts")


def rolling_rmse(s, d):
    """RMSE of a standardised ridge regression at every origin, each fitted on all events before; one pass for all."""
    found = rolling_frame(rolling_plan(_events(s, d), 500, 200, 100), blueprint())
    return found.select("fold", "start", "end", F.round("score", 6).alias("rmse"))


def rolling_rows(s, d):
    """Rows that the first three origins analyse and assess."""
    plan = rolling_plan(_events(s, d), 500, 200, 100)
    parts = [x.df.select(F.lit(i).alias("fold"), F.lit(role).alias("role"), "event_id") for i in range(3) for role, x in (("analysis", plan.analysis(i)), ("assessment", plan.assessment(i)))]
    return reduce(lambda a, b: a.unionByName(b), parts)


#: Candidates of `search_one_pass`: scaler and penalty.
_SCALERS = {"none": None, "scale-only": scalers.ScaleOnlyScaler, "standard": scalers.StandardScaler}
_CHOICES = [(k, p) for k in _SCALERS for p in (0.1, 100.0, 100000.0)]


def _chosen(choice):
    kind, penalty = choice
    start = Blueprint().via(_SCALERS[kind]()) if _SCALERS[kind] else Blueprint()
    return start.learn(ridge.Ridge(ridge.Config(penalty)))


def search_one_pass(s, d):
    """Three scalings by three penalties over five folds: forty-five fits from one pass over the rows."""
    rows = order_features(s, d)
    trials = search.cross_validated(_CHOICES, _chosen, k_fold(rows, 5, SEED), metrics.rmse(), SEED, "o_totalprice")[1]
    got = [(t.index, *t.candidate, k, round(x, 4)) for t in trials for k, x in enumerate(t.folds)]
    return s.createDataFrame(got, "index int, scaler string, penalty double, fold int, score double")


#: What `grid_candidates` and `random_candidates` search: how coordinates are scaled, and a penalty.
_SPACE = search.choice(*_SCALERS) * search.log_uniform(0.1, 100_000.0)
_POINTS, _TRIALS, _STREAM_SEED = 4, 12, 91


def _objectives(s, d, candidates):
    """The mean RMSE over five folds of each candidate, from one pass over the rows."""
    trials = search.cross_validated(candidates, _chosen, k_fold(order_features(s, d), 5, SEED), metrics.rmse(), SEED, "o_totalprice")[1]
    return s.createDataFrame([(t.index, t.candidate[0], round(t.candidate[1], 6), round(t.objective, 4)) for t in trials], "index int, scaler string, penalty double, objective double")


#: Prices of a unit that `study_select` tries; the last gives no number.
_SLOPES = [500.0, 1500.0, 2500.0, float("nan")]


def study_select(s, d):
    """Line items priced at so much a unit: the candidate of least RMSE, and how many were tried and have failed."""
    rows = priced(s, d).df.select(F.col("l_extendedprice").alias("truth"), "l_quantity")
    best, trials = search.study(_SLOPES, lambda c: metrics.rmse().evaluate(rows.withColumn("prediction", F.col("l_quantity") * c)))
    return s.createDataFrame([(best.candidate, round(best.objective, 4), len(trials), sum(t.error is not None for t in trials))], "candidate double, objective double, n int, failed int")


#: Encoder and learner of `crossfit_pipeline`.
_ENCODER, _RIDGE = CrossFitted("o_orderpriority", "encoded", 5), ridge.Ridge(ridge.Config(1.0))


def crossfit_pipeline(s, d):
    """A cross-fitted encoder in a blueprint: the fitted model's predictions for all rows."""
    rows = order_features(s, d)
    b = Blueprint().via(Mapped("per-line", {"per_line": F.col("quantity") / F.col("lines")})).via(_ENCODER).learn(_RIDGE)
    f = b.fit(rows.with_df(rows.df, role=Role.TRAIN), SEED)
    return f.apply(rows.df).select("o_orderkey", F.round("prediction", 3).alias("prediction"))


def artifact_round_trip(s, d):
    e = experiment(s, d, "validation").run("fit_candidate")
    back = artifacts.decode(artifacts.encode(e.candidate))
    part = e.split.validation
    a, b = e.candidate.predict(part), back.predict(part).withColumnRenamed("prediction", "again")
    return a.join(b, "o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("prediction") == F.col("again")).alias("same"))


def stream_scoring(s, d):
    """A folder of line items scored as a stream; the result is that of the batch."""
    rows = lines(s, d)
    fitted = Blueprint().learn(ridge.Ridge(ridge.Config(PENALTY))).fit(rows.with_df(rows.df, role=Role.TRAIN), SEED)
    root = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    rows.df.select("row_id", *rows.features).write.parquet(f"{root}/in")
    score_folder(s, fitted, f"{root}/in", f"{root}/out", f"{root}/state", "row_id long, l_quantity double, l_discount double").awaitTermination()
    return s.read.parquet(f"{root}/out").select("row_id", F.round("prediction", 4).alias("prediction"))


def artifact_folder(s, d):
    """A chain with a map and a cross-fitted encoder, kept as a folder with the encoder's table and read back: predictions of all rows by both."""
    rows = order_features(s, d)
    b = Blueprint().via(Mapped.of_sql("per-line", {"per_line": "quantity / lines"})).via(CrossFitted("o_custkey", "encoded", 5, then=scalers.StandardScaler())).learn(_RIDGE)
    fitted = b.fit(rows.with_df(rows.df, role=Role.TRAIN), SEED)
    at = f"{shared_folder(s)}/artifact-{uuid.uuid4().hex}"
    artifacts.save(fitted, s, at)
    a, again = fitted.predict(rows), artifacts.load(s, at).predict(rows).withColumnRenamed("prediction", "again")
    return a.join(again, "o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("prediction") == F.col("again")).alias("same"))


def stream_metric(s, d):
    """RMSE of a stream of scored line items, batch by batch, measured once more after a restart."""
    root = f"{shared_folder(s)}/metric-{uuid.uuid4().hex}"
    scored = priced(s, d).df.select(F.col("l_extendedprice").alias("truth"), (F.col("l_quantity") * 1500.0).alias("prediction"))
    scored.repartition(6).write.parquet(f"{root}/in")
    for _ in range(2):
        stream = s.readStream.schema("truth double, prediction double").option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
        stream_metrics.measure_stream(stream, metrics.rmse(), f"{root}/parts", f"{root}/state").awaitTermination()
    return s.createDataFrame([(round(stream_metrics.value(s, metrics.rmse(), f"{root}/parts"), 6),)], "value double")


def first_failure(s, d):
    """Orders with planted faults: infinite quantities, which scaling refuses, and numbers of lines so large that their predictions overflow. The first in the order of ids, with its stage."""
    rows = order_features(s, d)
    fitted = blueprint().fit(rows.with_df(rows.df, role=Role.TRAIN), SEED)
    bad = rows.df.withColumns({"quantity": F.when(F.col("o_orderkey") % 1013 == 0, float("inf")).otherwise(F.col("quantity")), "lines": F.when(F.col("o_orderkey") % 97 == 96, 1.5e308).otherwise(F.col("lines"))})
    late = rows.with_df(bad.where("o_orderkey > 100"))
    return fitted.first_failure(rows.with_df(bad)).unionByName(fitted.first_failure(late))


def audit_trail(s, d):
    e = experiment(s, d, "validation").run("fit_candidate")
    return s.createDataFrame([(i, x["stage"], str(x["seed"])) for i, x in enumerate(e.candidate.audit.details)], "ordinal int, stage string, seed string")


def selection_receipt(s, d):
    e = experiment(s, d, "validation").run("select")
    return s.createDataFrame([(e.selection.metric, e.selection.minimize, round(e.selection.score, 4), len(e.selection.hash))], "metric string, minimize boolean, score double, hex int")


QUERIES = {
    "experiment_validation": lambda s, d: _scored(experiment(s, d, "validation").run().validated),
    "experiment_validation_score": experiment_score,
    "experiment_tvt": lambda s, d: _scored(experiment(s, d, "train-validation-test").run().tested),
    "experiment_precommitted": lambda s, d: _scored(experiment(s, d, "precommitted").run().tested),
    "selected_refit": lambda s, d: _model(s, experiment(s, d, "validation").run("refit").selected.model),
    "deployment_refit": lambda s, d: _model(s, experiment(s, d, "train-validation-test").run("deployment_refit").deployed.model),
    "selection_receipt": selection_receipt,
    "audit_trail": audit_trail,
    "first_failure": first_failure,
    "artifact_folder": artifact_folder,
    "stream_metric": stream_metric,
    "cv_ridge_grid": cv_ridge_grid,
    "cv_ridge_best": cv_ridge_best,
    "cv_any_blueprint": cv_any_blueprint,
    "search_one_pass": search_one_pass,
    "rolling_rmse": rolling_rmse,
    "rolling_rows": rolling_rows,
    "grid_candidates": lambda s, d: _objectives(s, d, search.grid(_SPACE, _POINTS)),
    "random_candidates": lambda s, d: _objectives(s, d, search.random(_SPACE, _TRIALS, _STREAM_SEED)),
    "study_select": study_select,
    "crossfit_pipeline": crossfit_pipeline,
    "artifact_round_trip": artifact_round_trip,
    "stream_scoring": stream_scoring,
}

_PLAN = blueprint().plan


def _split_sql(v: str, t: str) -> str:
    """CTE u: order features with their role."""
    return f"""{ORDER_FEATURES}, {rank_sql("f", "o_orderkey", "o_orderkey, y, x1, x2", "r", "order_features", phase_seed(SEED, _PLAN, "split"))},
n AS (SELECT *, row_number() OVER (ORDER BY rank, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM r),
u AS (SELECT o_orderkey, y, x1, x2, CASE WHEN pos < {v} THEN 'validation' WHEN pos < {v} + {t} THEN 'test' ELSE 'train' END AS role FROM n)"""


def _fit_sql(v: str, t: str, fitted: str) -> str:
    """CTEs u, z (standardised) and ridge, fitted on the roles given."""
    return f"""{_split_sql(v, t)}, a AS (SELECT avg(x1) AS m1, 1 / sqrt(var_pop(x1)) AS s1, avg(x2) AS m2, 1 / sqrt(var_pop(x2)) AS s2 FROM u WHERE role IN ({fitted})),
z AS (SELECT o_orderkey, role, y, (x1 - m1) * s1 AS z1, (x2 - m2) * s2 AS z2 FROM u, a), k AS (SELECT * FROM z WHERE role IN ({fitted})), {ridge_sql("k", "z1", "z2", "y", "1.0", PENALTY)}"""


def _experiment_sql(v: str, t: str, fitted: str, scored: str) -> str:
    return f"WITH {_fit_sql(v, t, fitted)} SELECT o_orderkey, round(y, 4) AS truth, round(b0 + z1 * b1 + z2 * b2, 4) AS prediction FROM z, ridge WHERE role = '{scored}'"


def _model_sql(v: str, t: str, fitted: str) -> str:
    return f"WITH {_fit_sql(v, t, fitted)} SELECT CAST(-1 AS INTEGER) AS position, 'intercept' AS name, round(b0, 4) AS value FROM ridge UNION ALL SELECT 0, 'quantity', round(b1, 4) FROM ridge UNION ALL SELECT 1, 'lines', round(b2, 4) FROM ridge"


def _cv_sql(source: str, row_id: str, y: str, folds: int, penalties: list[float], first: str) -> str:
    """CTE c: RMSE of each penalty and fold, each by its own fit."""
    values = ", ".join(f"({i}, {p!r})" for i, p in enumerate(penalties))
    sums = "sum((x1 - m1) * (x1 - m1)) + pen.p AS a, sum((x1 - m1) * (x2 - m2)) AS b, sum((x2 - m2) * (x2 - m2)) + pen.p AS c, sum((x1 - m1) * (y - my)) AS q1, sum((x2 - m2) * (y - my)) AS q2"
    return f"""{first} {finalize_sql(source, f"xor(CAST({row_id} AS UBIGINT), {SEED}::UBIGINT)", f"{row_id}, x1, x2, y", "r")},
g AS (SELECT *, (row_number() OVER (ORDER BY rank, {row_id}) - 1) % {folds} AS fold FROM r), pen AS (SELECT * FROM (VALUES {values}) t(i, p)), k AS (SELECT * FROM range(0, {folds}) t(k)),
m AS (SELECT k, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM g, k WHERE fold <> k GROUP BY k),
s AS (SELECT m.k, pen.i, pen.p, any_value(m1) AS m1, any_value(m2) AS m2, any_value(my) AS my, {sums} FROM g JOIN m ON g.fold <> m.k CROSS JOIN pen GROUP BY m.k, pen.i, pen.p),
w AS (SELECT k, i, p, m1, m2, my, (c * q1 - b * q2) / (a * c - b * b) AS b1, (a * q2 - b * q1) / (a * c - b * b) AS b2 FROM s),
c AS (SELECT i, p, w.k AS fold, sqrt(avg((y - my - (x1 - m1) * b1 - (x2 - m2) * b2) ** 2)) AS score FROM g JOIN w ON g.fold = w.k GROUP BY i, p, w.k)"""


_LINE = LINES + ", h AS (SELECT row_id, CAST(l_quantity AS DOUBLE) AS x1, CAST(l_discount AS DOUBLE) AS x2, CAST(l_extendedprice AS DOUBLE) AS y FROM l),"
_CV = _cv_sql("h", "row_id", "y", 5, PENALTIES, _LINE)
_STREAM = finalize_sql("i", f"CAST((CAST({_STREAM_SEED} AS UHUGEINT) + (i + 1)::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)", "i", "q").replace("CASE WHEN xor(h, h >> 31) >= 9223372036854775808::UBIGINT THEN CAST(CAST(xor(h, h >> 31) AS HUGEINT) - 18446744073709551616 AS BIGINT) ELSE CAST(xor(h, h >> 31) AS BIGINT) END", "xor(h, h >> 31)")



_EVENTS = """e AS (SELECT event_id, CAST(user_id AS DOUBLE) AS x1, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS x2, CAST(value AS DOUBLE) AS y, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events),
w AS (SELECT DISTINCT i AS fold, 500 + i * 100 AS start, least(700 + i * 100, n) AS stop FROM e, range(0, 1000000) t(i) WHERE event_id = (SELECT min(event_id) FROM events) AND 500 + i * 100 < n)"""


def _centred_sql(source: str, by: str, factor: str, penalty: str) -> str:
    """CTE b: of each group (with its penalty `pen.p`, scaled by the reciprocal deviations to the power `factor`), the ridge regression of y on x1 and x2, for unscaled coordinates."""
    return f"""s AS (SELECT {by}, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM {source} GROUP BY ALL),
u AS (SELECT *, CASE WHEN {factor} THEN 1 / sqrt(v1) ELSE 1 END AS f1, CASE WHEN {factor} THEN 1 / sqrt(v2) ELSE 1 END AS f2 FROM s),
z AS (SELECT *, n * v1 * f1 * f1 + {penalty} AS a, n * c12 * f1 * f2 AS o, n * v2 * f2 * f2 + {penalty} AS c, n * c1 * f1 AS p1, n * c2 * f2 AS p2 FROM u),
b AS (SELECT *, (c * p1 - o * p2) / (a * c - o * o) * f1 AS b1, (a * p2 - o * p1) / (a * c - o * o) * f2 AS b2 FROM z)"""


_KINDS = ", ".join(f"({i}, '{k}')" for i, k in enumerate(_SCALERS))


def _search_sql(candidates: str) -> str:
    """CTEs up to c: the RMSE of each candidate (i, kind, p) and fold k, each by its own fit."""
    return f"""{ORDER_FEATURES}, {finalize_sql("f", f"xor(CAST(o_orderkey AS UBIGINT), {SEED}::UBIGINT)", "o_orderkey, x1, x2, y", "r")},
g AS (SELECT *, (row_number() OVER (ORDER BY rank, o_orderkey) - 1) % 5 AS fold FROM r),
pen AS ({candidates}),
{_centred_sql("range(0, 5) t(k) JOIN g ON g.fold <> t.k CROSS JOIN pen", "k, i, kind, pen.p", "kind <> 'none'", "p")},
c AS (SELECT CAST(i AS INTEGER) AS i, kind, p, CAST(k AS INTEGER) AS k, sqrt(avg((y - my - (x1 - m1) * b1 - (x2 - m2) * b2) ** 2)) AS score FROM b JOIN g ON g.fold = b.k GROUP BY i, kind, p, k)"""


def _objectives_sql(candidates: str, before: str = "") -> str:
    return f"WITH {before}{_search_sql(candidates)} SELECT i AS index, kind AS scaler, round(p, 6) AS penalty, round(avg(score), 4) AS objective FROM c GROUP BY i, kind, p"


def _audit_sql() -> str:
    """The stages of a candidate's fit, each with the finalizer of phase seed, plan and ordinal."""
    state = phase_seed(SEED, _PLAN, "candidate-fit") ^ fnv1a("\x1f".join(_PLAN).encode())
    stages = ", ".join(f"({i}, '{name}')" for i, name in enumerate(_PLAN))
    h = f"xor({state}::UBIGINT, CAST((i + 1)::UHUGEINT * {GAMMA}::UHUGEINT % {WORD} AS UBIGINT))"
    return f"""WITH a AS (SELECT i, stage FROM (VALUES {stages}) t(i, stage)), {finalize_sql("a", h, "i, stage", "r")}
SELECT CAST(i AS INTEGER) AS ordinal, stage, CAST(CASE WHEN rank < 0 THEN CAST(rank AS HUGEINT) + 18446744073709551616::HUGEINT ELSE CAST(rank AS HUGEINT) END AS VARCHAR) AS seed FROM r"""


def _crossfit_sql(plan: tuple[str, ...]) -> str:
    """Out-of-fold means by priority and the quantity a line, a ridge on both, served with the means of all rows; `plan` gives the encoder's seed."""
    seed = child_seed(SEED, fnv1a("\x1f".join(plan).encode()), 1)
    return f"""WITH {ORDER_FEATURES}, g AS (SELECT o_orderkey, y, o_orderpriority AS c, x1 / x2 AS p FROM f),
{finalize_sql("g", f"xor(CAST(o_orderkey AS UBIGINT), {seed}::UBIGINT)", "o_orderkey, y, c, p", "r")},
h AS (SELECT *, (row_number() OVER (ORDER BY rank, o_orderkey) - 1) % 5 AS fold FROM r),
e AS (SELECT t.fold, c, avg(y) AS v FROM h, range(0, 5) t(fold) WHERE h.fold <> t.fold GROUP BY t.fold, c),
k AS (SELECT h.o_orderkey, h.y, p AS x1, v AS x2 FROM h JOIN e ON h.fold = e.fold AND h.c = e.c), {ridge_sql("k", "x1", "x2", "y", "1.0", 1.0)},
w AS (SELECT c, avg(y) AS v FROM g GROUP BY c)
SELECT o_orderkey, round(b0 + p * b1 + w.v * b2, 3) AS prediction FROM g JOIN w ON g.c = w.c, ridge"""


ORACLE = {
    "audit_trail": _audit_sql(),
    "crossfit_pipeline": _crossfit_sql(("map:per-line@1", _ENCODER.name, _RIDGE.name)),
    "experiment_validation": _experiment_sql("(n // 5)", "0", "'train'", "validation"),
    "experiment_validation_score": f"WITH {_fit_sql('(n // 5)', '0', chr(39) + 'train' + chr(39))} SELECT count(*) AS n, round(sqrt(avg((y - b0 - z1 * b1 - z2 * b2) ** 2)), 4) AS score FROM z, ridge WHERE role = 'validation'",
    "experiment_tvt": _experiment_sql("(n // 5)", "(n // 10)", "'train', 'validation'", "test"),
    "experiment_precommitted": _experiment_sql("0", "(n // 10)", "'train'", "test"),
    "selected_refit": _model_sql("(n // 5)", "0", "'train', 'validation'"),
    "deployment_refit": _model_sql("(n // 5)", "(n // 10)", "'train', 'validation', 'test'"),
    "selection_receipt": f"WITH {_fit_sql('(n // 5)', '0', chr(39) + 'train' + chr(39))} SELECT 'rmse' AS metric, true AS minimize, round(sqrt(avg((y - b0 - z1 * b1 - z2 * b2) ** 2)), 4) AS score, CAST(16 AS INTEGER) AS hex FROM z, ridge WHERE role = 'validation'",
    "cv_ridge_grid": f"WITH {_CV} SELECT CAST(i AS INTEGER) AS index, CAST(p AS DOUBLE) AS penalty, CAST(fold AS INTEGER) AS fold, round(score, 4) AS score FROM c",
    "cv_ridge_best": f"WITH {_CV} SELECT CAST(i AS INTEGER) AS index, CAST(p AS DOUBLE) AS penalty, round(avg(score), 4) AS score FROM c GROUP BY i, p ORDER BY avg(score), i LIMIT 1",
    "cv_any_blueprint": f"WITH {_cv_sql('f', 'o_orderkey', 'y', 3, [0.1, 1000.0], ORDER_FEATURES + ',')} SELECT CAST(i AS INTEGER) AS index, CAST(p AS DOUBLE) AS penalty, round(avg(score), 4) AS score FROM c GROUP BY i, p",
    "artifact_folder": "SELECT count(*) AS n, true AS same FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)",
    "stream_metric": "SELECT round(sqrt(avg((l_extendedprice - l_quantity * 1500.0::DOUBLE) ** 2)), 6) AS value FROM lineitem",
    "first_failure": f"""WITH {ORDER_FEATURES}, b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 1013 = 0 THEN '0' ELSE '1' END AS path, CASE WHEN o_orderkey % 1013 = 0 THEN 'NonFiniteInput:quantity' ELSE 'NonFiniteOutput:prediction' END AS code FROM f WHERE o_orderkey % 1013 = 0 OR o_orderkey % 97 = 96)
(SELECT o_orderkey, path, code FROM b ORDER BY o_orderkey LIMIT 1) UNION ALL (SELECT o_orderkey, path, code FROM b WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 1)""",
    "rolling_rows": f"""WITH {_EVENTS} SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN pos < start THEN 'analysis' ELSE 'assessment' END AS role, event_id FROM w JOIN e ON pos < stop WHERE fold < 3""",
    "rolling_rmse": f"""WITH {_EVENTS}, {_centred_sql("w JOIN e ON e.pos < w.start", "fold", "true", str(PENALTY))}
SELECT CAST(w.fold AS INTEGER) AS fold, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end", round(sqrt(avg((y - my - (x1 - m1) * b1 - (x2 - m2) * b2) ** 2)), 6) AS rmse FROM w JOIN b ON w.fold = b.fold JOIN e ON e.pos >= start AND e.pos < stop GROUP BY ALL""",
    "search_one_pass": f"""WITH {_search_sql("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', {q!r})" for i, (k, q) in enumerate(_CHOICES)) + ") t(i, kind, p)")}
SELECT i AS index, kind AS scaler, CAST(p AS DOUBLE) AS penalty, k AS fold, round(score, 4) AS score FROM c""",
    "grid_candidates": _objectives_sql(f"SELECT CAST(row_number() OVER (ORDER BY a, e) - 1 AS INTEGER) AS i, kind, exp(ln(0.1) + e * (ln(100000.0) - ln(0.1)) / {_POINTS - 1}) AS p FROM (VALUES {_KINDS}) u(a, kind), range(0, {_POINTS}) v(e)"),
    "random_candidates": _objectives_sql(
        "SELECT CAST(drawn.i AS INTEGER) AS i, kind, exp(ln(0.1) + CAST(y >> 11 AS DOUBLE) / 9007199254740992 * (ln(100000.0) - ln(0.1))) AS p FROM drawn JOIN (VALUES " + _KINDS + f") u(a, kind) ON (x >> 1) % {len(_SCALERS)} = a",
        f"i AS (SELECT i FROM range(0, {2 * _TRIALS}) t(i)), {_STREAM}, drawn AS (SELECT i // 2 AS i, max(CASE WHEN i % 2 = 0 THEN rank END) AS x, max(CASE WHEN i % 2 = 1 THEN rank END) AS y FROM q GROUP BY 1), ",
    ),
    "study_select": f"SELECT c AS candidate, round(sqrt(avg((l_extendedprice - l_quantity * c) ** 2)), 4) AS objective, CAST({len(_SLOPES)} AS INTEGER) AS n, CAST(1 AS INTEGER) AS failed FROM lineitem, (VALUES {', '.join(f'({c!r}::DOUBLE)' for c in _SLOPES if c == c)}) t(c) GROUP BY c ORDER BY objective LIMIT 1",
    "artifact_round_trip": "SELECT count(*) // 5 AS n, true AS same FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)",
    "stream_scoring": f"WITH {_LINE} {ridge_sql('h', 'x1', 'x2', 'y', '1.0', PENALTY)} SELECT row_id, round(b0 + x1 * b1 + x2 * b2, 4) AS prediction FROM h, ridge",
}
