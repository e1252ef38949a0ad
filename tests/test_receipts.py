"""Ordered digests, provenance, positional plans, first failures in row order, authorities that outlast a driver."""

import threading
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from foldwise.functions.digests import Ordered, derived, ordered_digest
from foldwise.functions.hashing import Fingerprint
from foldwise.operators import encoders, metrics, resampling, ridge, scalers, splits
from foldwise.operators.stages import Blueprint, StageError
from foldwise.operators.state import global_position
from foldwise.plans.experiment import Authority, Experiment, ExperimentError, SharedAuthority, evaluate
from foldwise.sources import artifacts
from foldwise.sources.rows import DataError, Role, ordered_fingerprint, unsplit

SOURCE = Fingerprint("source-identity", ("test", "1"), "memory")


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(120).select("id", (F.col("id") * 7 % 13).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("z"), (F.col("id") % 4).alias("g"))
    return unsplit(df.withColumn("y", F.col("x") * 2 - F.col("z") + F.col("id") % 3).cache(), "id", SOURCE, features=("x", "z"), target="y", group="g")


def test_ordered_digests(spark, rows):
    found = {ordered_fingerprint(rows.df.repartition(n), "id", ("x", "z")).digest for n in (1, 3, 7)}
    assert len(found) == 1
    swapped = rows.df.withColumn("id", F.when(F.col("id") == 3, 4).when(F.col("id") == 4, 3).otherwise(F.col("id")))
    changed = rows.df.withColumn("x", F.when(F.col("id") == 3, 99.0).otherwise(F.col("x")))
    shorter = rows.df.where("id < 119")
    assert len({ordered_fingerprint(df, "id", ("x", "z")).digest for df in (swapped, changed, shorter, rows.df.where("id > 0"))} | found) == 5
    at = global_position(rows.df, [F.col("id")])
    whole = ordered_digest(at, ["id", "x"])
    for cut in (0, 1, 50, 120):
        a, b = ordered_digest(at.where(F.col("pos") < cut), ["id", "x"]), ordered_digest(at.where(F.col("pos") >= cut), ["id", "x"])
        assert a + b == whole and (b + a == whole) == (cut in (0, 120))
    assert ordered_digest(at.limit(0), ["id"]) == Ordered(0)
    nulls = spark.createDataFrame([(0, None, ""), (1, "", None)], "id long, a string, b string")
    assert ordered_fingerprint(nulls, "id", ("a",)).digest != ordered_fingerprint(nulls, "id", ("b",)).digest
    assert ordered_fingerprint(nulls.select("id", F.lit("x\x1f,+y").alias("a"), F.lit("z").alias("b")), "id", ("a", "b")).digest != ordered_fingerprint(nulls.select("id", F.lit("x").alias("a"), F.lit("y\x1f,+z").alias("b")), "id", ("a", "b")).digest


def test_fold_fingerprints(rows):
    plan = resampling.k_fold(rows, 4, 9)
    found = plan.fingerprints()
    for k, d in found.items():
        assert d.text == ordered_fingerprint(plan.assessment(k).df.repartition(3), "id").digest and d.n == 30
    assert len({d.text for d in found.values()}) == 4 and found == resampling.k_fold(rows.with_df(rows.df.repartition(5)), 4, 9).fingerprints()


def test_provenance(rows):
    s = splits.train_validation_test(rows, Fraction(1, 5), 10, 7)
    found = {r["role"]: r for r in s.provenance().collect()}
    assert {k: r["n"] for k, r in found.items()} == {"train": 86, "validation": 24, "test": 10}
    assert all(r["seed"] == 7 and r["source"] == "source-identity:test,1:memory" and r["policy"] == "validation=1/5,test=10" for r in found.values())
    assert found["test"]["ids"] == ordered_fingerprint(s.test.df, "id").digest and found["test"]["identity"] == s.test.fingerprint.digest
    other = splits.train_validation_test(rows, Fraction(1, 5), 10, 8)
    assert len({x.fingerprint.digest for x in (s.train, s.validation, s.test, other.train, rows)}) == 5
    assert derived("a", SOURCE, k=1) == derived("a", SOURCE, k=1) != derived("a", SOURCE, k=2)


def test_tampered_sources_are_refused(rows):
    b = Blueprint().via(scalers.StandardScaler()).learn(ridge.Ridge(ridge.Config(0.1)))
    one, two = (splits.validation(rows, 20, seed) for seed in (1, 2))
    fitted = b.fit(one.train, 0)
    assert evaluate(fitted, one.train, one.validation, metrics.rmse(), "y").rows == 20
    for wrong in (two.train, one.train.with_df(one.train.df, fingerprint=SOURCE), one.train.with_df(one.train.df, role=Role.REFIT)):
        with pytest.raises(DataError, match="FingerprintMismatch"):
            evaluate(fitted, wrong, one.validation, metrics.rmse(), "y")
    as_float = one.train.with_df(one.train.df.withColumn("x", F.col("x").cast("float")))
    assert b.fit(as_float, 0).audit.schema != fitted.audit.schema == artifacts.decode(artifacts.encode(fitted)).audit.schema


def test_positional_plans(spark, rows):
    digest = ordered_fingerprint(rows.df, "id").digest
    given = spark.range(120).select(F.col("id").alias("pos"), (F.col("id") % 3).cast("int").alias("fold"))
    plan = resampling.bound_by_position(rows, given.repartition(4), resampling.External(120, 3, 5, digest), 5)
    assert sorted((r["id"], r["fold"]) for r in plan.rows.df.collect()) == [(i, i % 3) for i in range(120)]
    for wrong, ext, seed, code in (
        (given, resampling.External(119, 3), None, "SizeMismatch"), (given, resampling.External(120, 3, 5), 6, "SeedMismatch"), (given, resampling.External(120, 3, 5, "120:0"), 5, "PopulationMismatch"),
        (given.where("pos < 119"), resampling.External(120, 3), None, "LengthMismatch"), (given.withColumn("pos", F.greatest(F.col("pos"), F.lit(1))), resampling.External(120, 3), None, "InvalidPositions"),
        (given, resampling.External(120, 2), None, "InvalidFold"), (given.withColumn("pos", F.col("pos") + 1), resampling.External(120, 3), None, "InvalidPositions"),
    ):
        with pytest.raises(DataError, match=code):
            resampling.bound_by_position(rows, wrong, ext, seed)


def test_zip_and_gather(spark, rows):
    at = global_position(rows.df.select("id", "x"), [F.desc("id")])
    weights = spark.range(120).select(F.col("id").alias("pos"), (F.col("id") * 10).alias("w"))
    assert all(r["w"] == 10 * (119 - r["id"]) for r in resampling.zipped(at, weights.repartition(3)).collect())
    with pytest.raises(DataError, match="LengthMismatch: 120 and 100"):
        resampling.zipped(at, weights.where("pos < 100"))
    with pytest.raises(DataError, match="ReservedName"):
        resampling.zipped(at, weights.withColumnRenamed("w", "x"))
    picked = spark.createDataFrame([(0,), (0,), (119,), (5,)], "pos long")
    assert sorted(r["id"] for r in resampling.gathered(at, picked, 120).collect()) == [0, 114, 119, 119]
    for bad in (120, -1, None):
        with pytest.raises(DataError, match="PositionOutOfRange"):
            resampling.gathered(at, spark.createDataFrame([(0,), (bad,)], "pos long"), 120)
    assert resampling.zipped(at.limit(0), weights.limit(0)).count() == 0


def test_first_failure_in_row_order(spark, rows, tmp_path):
    b = Blueprint().via(scalers.StandardScaler()).learn(ridge.Ridge(ridge.Config(0.1)))
    fitted = b.fit(rows.with_df(rows.df, role=Role.TRAIN), 0)
    assert fitted.first_failure(rows).count() == 0
    bad = rows.df.withColumns({"x": F.when(F.col("id").isin(40, 90), float("nan")).otherwise(F.col("x")), "z": F.when(F.col("id").isin(41, 77), 1.7e308).otherwise(F.col("z"))})
    for n in (1, 3, 7):
        got = fitted.first_failure(rows.with_df(bad.repartition(n))).collect()
        assert [tuple(r) for r in got] == [(40, "0", "NonFiniteInput:x")]
        with pytest.raises(StageError, match="stage 0: NonFiniteInput: row 40, x") as e:
            fitted.write_predictions(rows.with_df(bad.repartition(n)), str(tmp_path / "bad"))
        assert e.value.path == (0,) and not list(tmp_path.iterdir())
    late = rows.with_df(rows.df.withColumn("x", F.when(F.col("id") == 9, 1e308).otherwise(F.col("x"))))
    huge = Blueprint().learn(ridge.Ridge(ridge.Config(0.1))).fit(rows.with_df(rows.df, role=Role.TRAIN), 0)
    assert [tuple(r) for r in huge.first_failure(late).collect()] == [(9, "0", "NonFiniteOutput:prediction")]
    fitted.write_predictions(rows, str(tmp_path / "good"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "good")).collect())) == sorted(map(tuple, fitted.predict(rows).collect()))
    with pytest.raises(DataError, match="TargetExists"):
        fitted.write_predictions(rows, str(tmp_path / "good"))
    assert [p.name for p in tmp_path.iterdir()] == ["good"]
    nested = Blueprint().via(encoders.CrossFitted("g", "e", 3, then=scalers.StandardScaler())).learn(ridge.Ridge(ridge.Config(1.0))).fit(rows.with_df(rows.df, role=Role.TRAIN), 0)
    odd = rows.with_df(rows.df.withColumn("x", F.when(F.col("id") == 50, float("inf")).otherwise(F.col("x"))))
    assert [tuple(r) for r in nested.first_failure(odd).collect()] == [(50, "1", "NonFiniteOutput:prediction")] or nested.first_failure(odd).first()["path"] == "1"


def test_shared_authority(spark, rows, tmp_path):
    folder, won, lost = str(tmp_path / "marks"), [], []

    def run():
        try:
            won.append(SharedAuthority("why", spark, folder).take())
        except DataError as e:
            lost.append(e.code)

    threads = [threading.Thread(target=run) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert won == ["why"] and lost == ["RefitAlreadyTaken"] * 7
    assert SharedAuthority("another", spark, f"file://{folder}").take() == "another"
    b = Blueprint().learn(ridge.Ridge(ridge.Config(0.1)))
    first = Experiment("validation", rows, b, metrics.rmse(), 3, 20, authorities=folder).run("refit")
    with pytest.raises(ExperimentError, match="RefitAlreadyTaken"):  # a driver that starts the same experiment again
        Experiment("validation", rows, b, metrics.rmse(), 3, 20, authorities=folder).run("refit")
    assert first.selected and Experiment("validation", rows, b, metrics.rmse(), 4, 20, authorities=folder).run("refit").selected
    assert Authority("x").take() == "x"


def test_fold_keyed_stages(spark, rows):
    """Scalers within folds equal fits fold by fold, and read the rows as often for three folds as for eight."""
    for then in (scalers.StandardScaler(), scalers.ScaleOnlyScaler()):
        plan = resampling.k_fold(rows, 4, 2)
        encoded = encoders.out_of_fold(plan, "g", "e")
        got = {r["id"]: r["e"] for r in encoders.then_in_folds(plan, encoded, "g", "e", then, 0).df.collect()}
        for k in range(4):
            rest = plan.rows.with_df(plan.rows.df.where(F.col("fold") != k), role=Role.TRAIN)
            state = encoders.serving_state(rest, "g", "e")
            stage = then.fit(rest.with_df(state.apply(rest.df), features=("e",)), 0)
            for r in stage.apply(encoded.df.where(F.col("fold") == k)).collect():
                assert got[r["id"]] == pytest.approx(r["e"], rel=1e-9, abs=1e-9)

    def reads(k):
        plan = resampling.k_fold(rows, k, 2)
        encoded = encoders.out_of_fold(plan, "g", "e")
        group = f"reads-{k}"
        spark.sparkContext.setJobGroup(group, "counted")
        done = encoders.then_in_folds(plan, encoded, "g", "e", scalers.ScaleOnlyScaler(), 0).df
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), done._jdf.queryExecution().optimizedPlan().toString().count("Relation")

    assert reads(3) == reads(8)
    constant = rows.with_df(rows.df.withColumn("y", F.lit(1.0)))
    plan = resampling.k_fold(constant, 3, 2)
    with pytest.raises(DataError, match="ConstantCoordinate: e"):
        encoders.then_in_folds(plan, encoders.out_of_fold(plan, "g", "e"), "g", "e", scalers.StandardScaler("reject"), 0)
