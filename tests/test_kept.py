"""Artifacts with tables, and metrics of streams that are restarted or replayed."""

import shutil

import pytest
from pyspark.sql import functions as F

from foldwise.operators import encoders, metrics, ridge, scalers
from foldwise.operators.stages import Blueprint, Mapped
from foldwise.sources import artifacts
from foldwise.sources.rows import DataError, Role, unsplit
from foldwise.streaming import metrics as stream_metrics


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(90).select("id", (F.col("id") * 7 % 13).cast("double").alias("x"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("g"), F.col("id") % 6)).alias("g"))
    return unsplit(df.withColumn("y", F.col("x") * 2 + F.length(F.coalesce("g", F.lit(""))) + F.col("id") % 3).cache(), "id", features=("x",), target="y", role=Role.TRAIN)


def test_folders_with_state(spark, rows, tmp_path):
    learner = ridge.Ridge(ridge.Config(0.5))
    blueprints = [
        Blueprint().via(Mapped.of_sql("more", {"x": "x", "xx": "x * x"})).via(encoders.CrossFitted("g", "e", 3, then=scalers.StandardScaler())).learn(learner),
        Blueprint().via(scalers.StandardScaler()).via(encoders.CrossFitted("g", "e", 3)).learn(learner),
        Blueprint().via(encoders.MeanTarget()).learn(learner),
        Blueprint().learn(learner),
    ]
    for i, b in enumerate(blueprints):
        fitted, at = b.fit(rows, 4), str(tmp_path / str(i))
        artifacts.save(fitted, spark, at)
        back = artifacts.load(spark, at)
        assert back.audit == fitted.audit and back.audit.digest == fitted.audit.digest
        assert sorted(map(tuple, back.predict(rows).collect())) == sorted(map(tuple, fitted.predict(rows).collect()))
        artifacts.save(back, spark, f"{at}-again")
        with pytest.raises(DataError, match="TargetExists"):
            artifacts.save(fitted, spark, at)
    assert not [p for p in tmp_path.iterdir() if ".part-" in p.name]


def test_broken_folders_are_refused(spark, rows, tmp_path):
    fitted = Blueprint().via(encoders.CrossFitted("g", "e", 3)).learn(ridge.Ridge(ridge.Config(0.5))).fit(rows, 4)
    whole = tmp_path / "whole"
    artifacts.save(fitted, spark, str(whole))

    def broken(name, change):
        at = tmp_path / name
        shutil.copytree(whole, at)
        change(at)
        return str(at)

    def less(at):
        spark.read.parquet(str(whole / "tables/0")).limit(2).write.mode("overwrite").parquet(str(at / "tables/0"))

    def edited(at):
        f = next((at / "manifest").glob("part-*"))
        f.write_text(f.read_text().replace('"overall":', '"overall":1'))
        next((at / "manifest").glob(".part-*.crc")).unlink()

    for name, change, code in (("no-manifest", lambda at: shutil.rmtree(at / "manifest"), "Incomplete"), ("half", lambda at: (at / "tables/0/_SUCCESS").unlink(), "Incomplete"), ("fewer", less, "Incomplete"), ("edited", edited, "WrongDigest")):
        with pytest.raises(DataError, match=code):
            artifacts.load(spark, broken(name, change))
    with pytest.raises(DataError, match="Incomplete"):
        artifacts.load(spark, str(tmp_path / "nothing"))
    with pytest.raises(DataError, match="NoCodec"):
        artifacts.encode(fitted)
    with pytest.raises(DataError, match="NoCodec"):
        artifacts.save(Blueprint().via(Mapped("m", {"x": F.col("x")})).learn(ridge.Ridge(ridge.Config(1.0))).fit(rows, 1), spark, str(tmp_path / "column"))


@pytest.mark.parametrize("metric", [metrics.rmse(), metrics.weighted_rmse(), metrics.accuracy()])
def test_metrics_of_streams(spark, tmp_path, metric):
    def scored(lo, hi):
        return spark.range(lo, hi).select((F.col("id") % 7 / 3).alias("truth"), (F.col("id") % 5 / 3).alias("prediction"), (F.col("id") % 3 + 0.1).alias("weight")).repartition(4)

    source, parts, state = (str(tmp_path / x) for x in ("in", "parts", "state"))

    def run():
        stream = spark.readStream.schema("truth double, prediction double, weight double").option("maxFilesPerTrigger", 1).parquet(source)
        stream_metrics.measure_stream(stream, metric, parts, state).awaitTermination()

    scored(0, 200).write.parquet(source)
    run()
    assert stream_metrics.value(spark, metric, parts) == pytest.approx(metric.evaluate(scored(0, 200)), rel=1e-15)
    run()  # nothing new
    scored(200, 333).write.mode("append").parquet(source)
    run()
    want = metric.evaluate(scored(0, 333))
    assert stream_metrics.value(spark, metric, parts) == pytest.approx(want, rel=1e-15)
    # the last batch is run again, as after a failure before its commit was noted
    last = max(int(p.name) for p in (tmp_path / "state/commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "state/commits").iterdir():
        if p.name.strip(".crc") in (str(last), f"{last}") or p.name == f".{last}.crc":
            p.unlink()
    shutil.rmtree(tmp_path / "parts" / f"batch={last}")
    run()
    assert stream_metrics.value(spark, metric, parts) == pytest.approx(want, rel=1e-15)
    with pytest.raises(DataError, match="Empty"):
        stream_metrics.partials(scored(0, 0), metric).write.parquet(str(tmp_path / "none" / "batch=0"))
        stream_metrics.value(spark, metric, str(tmp_path / "none"))
