"""Experiments: partition, fit, validate, select, refit and test, each step once, with receipts that name what they rest on."""

from __future__ import annotations

import hashlib
import os
import threading
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions.digests import derived
from foldwise.functions.hashing import finalize, fnv1a, framed, hex16
from foldwise.operators.metrics import Metric
from foldwise.operators.splits import Amount, Split, holdout, train_validation_test, validation
from foldwise.operators.stages import Blueprint, Fitted, StageError, data_identity
from foldwise.operators.state import hadoop_paths
from foldwise.sources.rows import DataError, Role, Rows, overlap

PHASES = ("split", "candidate-fit", "validation", "selected-refit", "test", "deployment-refit")


class ExperimentError(DataError):
    """A failure in a phase; `cause` is what failed."""

    def __init__(self, phase: str, cause: DataError):
        super().__init__(cause.code, f"{phase}: {cause}")
        self.phase, self.cause = phase, cause


def phase_seed(root: int, plan: tuple[str, ...], phase: str) -> int:
    """One root seed gives each phase its own, by plan and phase."""
    if phase not in PHASES:
        raise DataError("UnknownPhase", phase)
    return finalize(root ^ fnv1a(b"".join(map(framed, ("foldwise.phase-v1", *plan, phase)))))


def receipt_hash(kind: str, *parts: object) -> str:
    return hex16(fnv1a(b"".join(framed(str(p)) for p in (kind, *parts))))


@dataclass(frozen=True)
class Evaluation:
    """A score of held-out rows and what it rests on."""

    role: Role
    metric: str
    score: float
    rows: int
    fitted: str
    scored: DataFrame

    @property
    def hash(self) -> str:
        return receipt_hash("evaluation", self.role.value, self.metric, repr(self.score), self.rows, self.fitted)


@dataclass(frozen=True)
class Selection:
    evaluation: str
    metric: str
    minimize: bool
    score: float
    candidate: str

    @property
    def hash(self) -> str:
        return receipt_hash("selection", self.evaluation, self.metric, self.minimize, repr(self.score), self.candidate)


class Authority:
    """Leave to refit, once."""

    def __init__(self, reason: str):
        self.reason, self._lock, self._used = reason, threading.Lock(), False

    def take(self) -> str:
        with self._lock:
            if self._used:
                raise DataError("RefitAlreadyTaken", self.reason)
            self._used = True
        return self.reason


class SharedAuthority(Authority):
    """Leave to refit once, for all drivers that share a folder: a retried or second driver can't take it again.

    A mark is created exclusively in the folder, which must be kept as long as that shall hold. Local folders and HDFS create it atomically;
    other stores do as far as their file system refuses to overwrite.
    """

    def __init__(self, reason: str, spark: SparkSession, folder: str):
        super().__init__(reason)
        self.spark, self.path = spark, f"{folder.rstrip('/')}/refit-{hashlib.sha256(reason.encode()).hexdigest()}"

    def take(self) -> str:
        super().take()
        fs, (path,) = hadoop_paths(self.spark, self.path)
        try:
            if fs.getUri().getScheme() == "file":
                local = path.toUri().getPath()
                os.makedirs(os.path.dirname(local), exist_ok=True)
                os.close(os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            else:
                fs.create(path, False).close()
        except (FileExistsError, Py4JJavaError) as e:
            if isinstance(e, FileExistsError) or fs.exists(path):
                raise DataError("RefitAlreadyTaken", self.reason) from None
            raise
        return self.reason


def observed(*parts: Rows) -> Rows:
    """All rows seen so far, as refit rows: lawful only with an authority (see `refit`)."""
    first = parts[0]
    df = first.df
    for p in parts[1:]:
        df = df.unionByName(p.df)
    return first.with_df(df, role=Role.REFIT, fingerprint=derived("observation", *(p.fingerprint for p in parts)))


def refit(blueprint: Blueprint, authority: Authority, parts: list[Rows], seed: int) -> Fitted:
    authority.take()
    return blueprint.fit(observed(*parts), seed)


def evaluate(fitted: Fitted, trained_on: Rows, held_out: Rows, metric: Metric, truth: str, weight: str | None = None) -> Evaluation:
    """Score held-out rows, after checking that the model was fitted on `trained_on`, that there are some held-out rows, and that the fit never saw any of them."""
    if not held_out.role.evaluates:
        raise DataError("NotEvaluationData", held_out.role.value)
    if fitted.audit.data != data_identity(trained_on):
        raise DataError("FingerprintMismatch", f"{fitted.audit.data} was fitted, not {data_identity(trained_on)}")
    held_out.non_empty()
    seen = overlap(trained_on.df, held_out.df, held_out.row_id).limit(1).collect()
    if seen:
        raise DataError("DuplicateObservedRow", str(seen[0][0]))
    keep = [F.col(held_out.row_id), F.col(truth).cast("double").alias("truth"), "prediction"] + ([F.col(weight).alias("weight")] if weight else [])
    scored = fitted.apply(held_out.df).select(*keep)
    return Evaluation(held_out.role, metric.name, metric.evaluate(scored), held_out.count(), fitted.audit.digest, scored)


class Experiment:
    """A run of one blueprint over unsplit rows. Steps go in their route's order; each gives back the experiment itself."""

    ROUTES = {
        "validation": ("partition", "fit_candidate", "validate", "select", "refit"),
        "train-validation-test": ("partition", "fit_candidate", "validate", "select", "refit", "test", "deployment_refit"),
        "precommitted": ("partition", "fit_candidate", "test", "deployment_refit"),
    }
    #: How far `run` goes.
    STOPS = {"validation": "validate", "train-validation-test": "test", "precommitted": "test"}

    def __init__(self, route: str, rows: Rows, blueprint: Blueprint, metric: Metric, seed: int, validation: Amount | None = None, test: Amount | None = None, weight: str | None = None, authorities: str | None = None):
        """`authorities`: a folder that all drivers share; with it each refit is granted once however often the experiment is started again."""
        if route not in self.ROUTES:
            raise DataError("UnknownRoute", route)
        self.route, self.rows, self.blueprint, self.metric, self.seed = route, rows, blueprint, metric, seed
        self.amounts, self.weight, self.done, self.authorities = (validation, test), weight, [], authorities
        self.split: Split | None = None
        self.candidate: Fitted | None = None
        self.selected: Fitted | None = None
        self.deployed: Fitted | None = None
        self.validated: Evaluation | None = None
        self.selection: Selection | None = None
        self.tested: Evaluation | None = None

    def step(self, name: str) -> Experiment:
        route = self.ROUTES[self.route]
        if len(self.done) == len(route) or route[len(self.done)] != name:
            raise DataError("StepOutOfOrder", name)
        try:
            getattr(self, f"_{name}")()
        except (StageError, DataError) as e:
            raise ExperimentError(name, e) from e
        self.done.append(name)
        return self

    def run(self, to: str | None = None) -> Experiment:
        """All steps up to and with `to`, by default the route's usual stop."""
        to = to or self.STOPS[self.route]
        while to not in self.done:
            self.step(self.ROUTES[self.route][len(self.done)])
        return self

    def of(self, phase: str) -> int:
        return phase_seed(self.seed, self.blueprint.plan, phase)

    def _granted(self, reason: str) -> Authority:
        return SharedAuthority(reason, self.rows.df.sparkSession, self.authorities) if self.authorities else Authority(reason)

    def _partition(self) -> None:
        v, t = self.amounts
        seed = self.of("split")
        if self.route == "validation":
            self.split = validation(self.rows, v, seed)
        elif self.route == "precommitted":
            self.split = holdout(self.rows, t, seed)
        else:
            self.split = train_validation_test(self.rows, v, t, seed)

    def _fit_candidate(self) -> None:
        self.candidate = self.blueprint.fit(self.split.train, self.of("candidate-fit"))

    def _validate(self) -> None:
        self.validated = evaluate(self.candidate, self.split.train, self.split.validation, self.metric, self.rows.target, self.weight)

    def _select(self) -> None:
        v = self.validated
        self.selection = Selection(v.hash, v.metric, self.metric.minimize, v.score, self.candidate.audit.digest)
        self.authority = self._granted(self.selection.hash)

    def _refit(self) -> None:
        self.selected = refit(self.blueprint, self.authority, [self.split.train, self.split.validation], self.of("selected-refit"))

    def _test(self) -> None:
        if self.route == "precommitted":
            fitted, seen = self.candidate, self.split.train
        else:
            fitted, seen = self.selected, observed(self.split.train, self.split.validation)
        self.tested = evaluate(fitted, seen, self.split.test, self.metric, self.rows.target, self.weight)
        self.deployment = self._granted(self.tested.hash)

    def _deployment_refit(self) -> None:
        parts = [self.split.train, self.split.test] if self.route == "precommitted" else [self.split.train, self.split.validation, self.split.test]
        self.deployed = refit(self.blueprint, self.deployment, parts, self.of("deployment-refit"))
