"""Fitted stages: columns to columns, composed as a flat list, so that no bracketing can change a plan."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, fields, is_dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from foldwise.functions.hashing import GAMMA, finalize, fnv1a, hex16
from foldwise.operators.coordinates import descriptor
from foldwise.operators.state import hadoop_paths
from foldwise.sources.rows import DataError, Rows


class StageError(DataError):
    """A failure and the ordinal path of the stage where it happened."""

    def __init__(self, path: tuple[int, ...], cause: DataError):
        super().__init__(cause.code, f"stage {'.'.join(map(str, path))}: {cause}")
        self.path, self.cause = path, cause


@dataclass(frozen=True)
class Audit:
    """What a fit has used: stage names, seeds, data identity, each component's own record, and the digest of the features' names and types."""

    plan: tuple[str, ...]
    seed: int
    data: str
    details: tuple[dict, ...] = ()
    schema: str = ""

    @property
    def plan_hash(self) -> int:
        return fnv1a("\x1f".join(self.plan).encode())

    @property
    def digest(self) -> str:
        return hex16(fnv1a(json.dumps([self.plan, self.seed, self.data, self.details, self.schema], sort_keys=True).encode()))


def data_identity(rows: Rows) -> str:
    return f"{rows.fingerprint.policy}:{rows.fingerprint.digest}:{rows.role.value}"


def plain(value):
    """A record in values that come back from JSON unchanged; what has no such form becomes a string."""
    if is_dataclass(value):
        return {f.name: plain(getattr(value, f.name)) for f in fields(value)}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def child_seed(seed: int, plan_hash: int, ordinal: int) -> int:
    """The seed of the stage with that ordinal: domain-separated by the plan."""
    return finalize(seed ^ plan_hash ^ GAMMA * (ordinal + 1))


class Stage:
    """A fitted stage. `apply` adds or replaces feature columns of any frame with the same ones, streaming ones too. Its `features`, if it has any, are the coordinates of what it gives out."""

    name = "stage"

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def record(self) -> dict:
        return {}


@dataclass(frozen=True)
class Named(Stage):
    """A row-wise map of known name and version: new feature columns as expressions over the old ones."""

    label: str
    version: int
    outputs: dict[str, Column] = field(hash=False)
    sql: tuple[tuple[str, str], ...] | None = None

    @property
    def name(self) -> str:
        return f"map:{self.label}@{self.version}"

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(self.outputs)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.outputs)


class Transform:
    """Learns a stage from inputs alone; what it gives out for the fitting rows is the stage's replay of them."""

    name = "transform"
    supervised = False

    def fit(self, rows: Rows, seed: int) -> Stage:
        raise NotImplementedError


class Mapped(Transform):
    """A map as a transform with nothing to learn. Fitted stages are refused: they would smuggle in rows that they have seen."""

    def __init__(self, label: str, outputs: dict[str, Column], version: int = 1):
        if any(isinstance(x, (Stage, Transform)) for x in outputs.values()):
            raise TypeError("a map takes column expressions, not stages")
        self.stage = Named(label, version, outputs)
        self.name = self.stage.name

    @classmethod
    def of_sql(cls, label: str, expressions: dict[str, str], version: int = 1) -> Mapped:
        """A map given as SQL expressions: it can be kept in an artifact."""
        out = cls(label, {k: F.expr(e) for k, e in expressions.items()}, version)
        out.stage = Named(label, version, out.stage.outputs, tuple(expressions.items()))
        return out

    def fit(self, rows: Rows, seed: int) -> Stage:
        return self.stage


@dataclass(frozen=True)
class Renamed(Stage):
    """A fitted stage whose failures have other codes."""

    inner: Stage
    codes: Callable[[Column], Column] = field(hash=False)

    @property
    def name(self) -> str:
        return self.inner.name

    @property
    def features(self) -> tuple[str, ...]:
        return getattr(self.inner, "features", ())

    def apply(self, df: DataFrame) -> DataFrame:
        return self.inner.apply(df)

    def guarded(self, df: DataFrame) -> DataFrame:
        guarded, before = getattr(self.inner, "guarded", None), [F.col("_before")] if "error" in df.columns else []
        df = df.withColumnRenamed("error", "_before")
        out = guarded(df) if guarded else self.inner.apply(df).withColumn("error", F.lit(None).cast("string"))
        return out.withColumn("error", F.coalesce(*before, F.when(F.col("error").isNotNull(), self.codes(F.col("error"))))).drop("_before")

    def record(self) -> dict:
        return self.inner.record()


class MapError(Transform):
    """A transform whose failures, in a fit and row by row, get other codes; what it learns and gives out is the same."""

    def __init__(self, part: Transform, codes: dict[str, str]):
        if part.supervised:
            raise TypeError("a supervised feature map is no transform")
        self.part, self.codes, self.name = part, dict(codes), part.name

    def column(self, code: Column) -> Column:
        """The code with its kind, what stands before a colon, exchanged; other kinds stay."""
        kind, out = F.substring_index(code, ":", 1), code
        for old, new in self.codes.items():
            out = F.when(kind == old, F.concat(F.lit(new), F.substr(code, F.length(kind) + 1))).otherwise(out)
        return out

    def fit(self, rows: Rows, seed: int) -> Stage:
        try:
            return Renamed(self.part.fit(rows, seed), self.column)
        except DataError as e:
            raise DataError(self.codes.get(e.code, e.code), str(e).partition(": ")[2]) from e


class FeatureMap(Transform):
    """Learns from targets too. Its output for the fitting rows isn't a replay (out-of-fold encodings), so nothing may be fitted on that but a learner."""

    name = "feature-map"
    supervised = True

    def fit_encode(self, rows: Rows, seed: int) -> tuple[Stage, Rows]:
        raise NotImplementedError


class Learner:
    """The last stage: learns predictions of the target."""

    name = "learner"

    def fit(self, rows: Rows, seed: int) -> Stage:
        raise NotImplementedError


@dataclass(frozen=True)
class Fitted:
    """A fitted chain: stages in order, the last one predicts; and its audit, which always comes along."""

    stages: tuple[Stage, ...]
    audit: Audit

    @property
    def model(self) -> Stage:
        return self.stages[-1]

    def apply(self, df: DataFrame) -> DataFrame:
        for s in self.stages:
            df = s.apply(df)
        return df

    def predict(self, rows: Rows, check: bool = True) -> DataFrame:
        """(row id, prediction) of all rows. A job that reads predictions fails at one that is null or isn't finite; without `check` it comes out as it is."""
        out, p = self.apply(rows.df), F.col("prediction")
        if check:
            number = isinstance(out.schema["prediction"].dataType, (DoubleType, FloatType))
            bad = p.isNull() | (F.isnan(p) | (F.abs(p) == float("inf"))) if number else p.isNull()
            name = F.coalesce(F.col(rows.row_id).cast("string"), F.lit("null"))
            p = F.when(bad, F.raise_error(F.concat(F.lit("NonFinitePrediction: row "), name))).otherwise(p)
        return out.select(rows.row_id, p.alias("prediction"))

    def checked(self, rows: Rows) -> DataFrame:
        """The rows with all features, `prediction` and `failure`: (stage path, code) of the first stage that fails for a row, null for a good row."""
        df, failure = rows.df.drop("error"), F.lit(None).cast("struct<path:array<int>,code:string>")
        for path, stage in _flat(self.stages):
            guarded = getattr(stage, "guarded", None)
            df = guarded(df) if guarded else stage.apply(df).withColumn("error", F.lit(None).cast("string"))
            failed = F.struct(F.lit(list(path)).cast("array<int>").alias("path"), F.col("error").alias("code"))
            df = df.withColumn("_failure", F.coalesce(failure, F.when(F.col("error").isNotNull(), failed))).drop("error")
            failure = F.col("_failure")
        return df.withColumnRenamed("_failure", "failure")

    def first_failure(self, rows: Rows) -> DataFrame:
        """(row id, path, code) of the failing row with the least id: no row if all are good. The same for every partitioning; one aggregate."""
        m = self.checked(rows).agg(first_of(rows.row_id).alias("m")).where("m is not null")
        return m.select(F.col("m.row").alias(rows.row_id), F.array_join(F.col("m.failure.path").cast("array<string>"), ".").alias("path"), F.col("m.failure.code").alias("code"))

    def write_predictions(self, rows: Rows, path: str) -> None:
        """Write (row id, prediction) of all rows as Parquet. If any row fails, StageError names the first in the order of ids, found in the same pass; what was written then has no success mark.

        The table is written beside its place and takes it only when all rows are good.
        """
        seen, part = Observation(), f"{path}.part-{uuid.uuid4().hex}"
        out = self.checked(rows).observe(seen, first_of(rows.row_id).alias("first")).select(rows.row_id, "prediction")
        out.write.parquet(part)
        first = seen.get["first"]
        fs, (source, target) = hadoop_paths(rows.df.sparkSession, part, path)
        if first is not None:
            fs.delete(source, True)
            raise StageError(tuple(first["failure"]["path"]), DataError(first["failure"]["code"].partition(":")[0], f"row {first['row']}, {first['failure']['code'].partition(':')[2]}"))
        if fs.exists(target) or not fs.rename(source, target):
            fs.delete(source, True)
            raise DataError("TargetExists", path)


def first_of(row_id: str) -> Column:
    """The least (row, failure) of the rows that have one."""
    return F.min(F.when(F.col("failure").isNotNull(), F.struct(F.col(row_id).alias("row"), "failure")))


def _flat(stages: tuple, path: tuple[int, ...] = ()) -> list[tuple[tuple[int, ...], Stage]]:
    """Stages with their ordinal paths, chained ones taken apart."""
    out = []
    for i, stage in enumerate(stages):
        parts = (stage.first, stage.second) if hasattr(stage, "first") and hasattr(stage, "second") else None
        out += _flat(parts, (*path, i)) if parts else [((*path, i), stage)]
    return out


class Blueprint:
    """A chain to be fitted: transforms, at most one supervised feature map, then a learner. Unlawful orders raise TypeError."""

    def __init__(self, parts: tuple = ()):
        self.parts = parts

    def via(self, part: Transform) -> Blueprint:
        if isinstance(part, (Stage, Fitted)):
            raise TypeError("a fitted stage can't be part of a blueprint")
        if not isinstance(part, Transform):
            raise TypeError(f"{part!r} is no transform")
        if any(isinstance(p, Learner) for p in self.parts):
            raise TypeError("nothing follows a learner")
        if any(p.supervised for p in self.parts) and not isinstance(part, Mapped):
            raise TypeError("only maps and a learner may follow a supervised feature map")
        return Blueprint((*self.parts, part))

    def learn(self, learner: Learner) -> Blueprint:
        if not isinstance(learner, Learner):
            raise TypeError(f"{learner!r} is no learner")
        if any(isinstance(p, Learner) for p in self.parts):
            raise TypeError("a blueprint has one learner")
        return Blueprint((*self.parts, learner))

    @property
    def plan(self) -> tuple[str, ...]:
        return tuple(p.name for p in self.parts)

    def fit(self, rows: Rows, seed: int) -> Fitted:
        """Fit part after part on what the part before gives out for the fitting rows, which must be train or refit rows."""
        rows.fitting()
        if not self.parts or not isinstance(self.parts[-1], Learner):
            raise TypeError("a blueprint ends in a learner")
        audit = Audit(self.plan, seed, data_identity(rows), (), descriptor(rows.df, rows.features)["digest"])
        stages, details = [], []
        for i, part in enumerate(self.parts):
            own = child_seed(seed, audit.plan_hash, i)
            try:
                if isinstance(part, FeatureMap):
                    stage, rows = part.fit_encode(rows, own)
                else:
                    stage = part.fit(rows, own)
                    if not isinstance(part, Learner):
                        rows = rows.with_df(stage.apply(rows.df), features=getattr(stage, "features", ()) or rows.features)
            except StageError:
                raise
            except DataError as e:
                raise StageError((i,), e) from e
            stages.append(stage)
            details.append(plain({"stage": part.name, "ordinal": i, "seed": own, **stage.record()}))
        return Fitted(tuple(stages), Audit(audit.plan, seed, audit.data, tuple(details), audit.schema))


def checked(df: DataFrame, features: tuple[str, ...], outputs: dict[str, Column]) -> DataFrame:
    """Add outputs and `error`, the first of: an input that isn't finite, an output that isn't, lowest index first. An earlier stage's error wins."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    found = [F.when(bad(F.col(f).cast("double")), F.concat(F.lit("NonFiniteInput:"), F.lit(f))) for f in features]
    found += [F.when(bad(c), F.concat(F.lit("NonFiniteOutput:"), F.lit(name))) for name, c in outputs.items()]
    before = [F.col("error")] if "error" in df.columns else []
    return df.withColumns({**outputs, "error": F.coalesce(*before, *found)})
