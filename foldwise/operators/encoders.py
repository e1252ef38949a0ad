"""Target encoders whose values for a fitting row never saw that row's own target."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.operators.resampling import Plan, k_fold
from foldwise.operators.scalers import Moments, Scaled, StandardScaler
from foldwise.operators.stages import FeatureMap, Mapped, Stage, Transform
from foldwise.operators.state import checkpoint, written
from foldwise.sources.rows import DataError, Role, Rows

#: States of up to so many categories are broadcast when they serve, larger ones joined by a shuffle.
BROADCAST_STATES = 100_000


def free(df: DataFrame) -> None:
    """Refuse columns named as those that the joins use."""
    if taken := {"_category", "_fold", "_value"} & set(df.columns):
        raise DataError("ReservedName", ", ".join(sorted(taken)))


@dataclass(frozen=True)
class Encoded(Stage):
    """Serving state: the mean target of each category over all fitting rows, the overall mean for categories unknown to it."""

    category: str
    output: str
    state: DataFrame
    overall: float
    small: bool
    features: tuple[str, ...] = ()
    name: str = "target-mean"

    def apply(self, df: DataFrame) -> DataFrame:
        free(df)
        side = self.state.select(F.col("category").alias("_category"), F.col("value").alias("_value"))
        joined = df.join(F.broadcast(side) if self.small else side, df[self.category].eqNullSafe(F.col("_category")), "left")
        return joined.withColumn(self.output, F.coalesce("_value", F.lit(self.overall))).drop("_category", "_value")

    def record(self) -> dict:
        return {"overall": self.overall, "category": self.category}


def serving_state(rows: Rows, category: str, output: str) -> Encoded:
    r = rows.df.agg(F.avg(rows.target).alias("m")).first()
    if r["m"] is None:
        raise DataError("EmptyData")
    state = checkpoint(rows.df.groupBy(F.col(category).alias("category")).agg(F.avg(rows.target).alias("value")))
    return Encoded(category, output, state, float(r["m"]), state.count() <= BROADCAST_STATES, (*rows.features, output))


def out_of_fold(plan: Plan, category: str, output: str) -> Rows:
    """Each row's category mean over the other folds; the other folds' overall mean where they don't have the category.

    One aggregate by (category, fold), then sums over a category's folds less the row's own fold: the sums of the others are
    added, not the own one subtracted, so that nothing cancels. The state is as small as categories times folds.
    """
    if not plan.complete:
        raise DataError("IncompletePlan")
    rows, y = plan.rows, F.col(plan.rows.target).cast("double")
    free(rows.df)
    cells = checkpoint(rows.df.groupBy(F.col(category).alias("_category"), F.col("fold").alias("_fold")).agg(F.sum(y).alias("s"), F.count(F.lit(1)).alias("n")))
    folds = cells.groupBy("_fold").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    overall = {r["_fold"]: (sum(x["s"] for x in folds if x["_fold"] != r["_fold"]), sum(x["n"] for x in folds if x["_fold"] != r["_fold"])) for r in folds}
    if any(n == 0 for _, n in overall.values()):
        raise DataError("EmptyAnalysis")
    means = F.create_map(*[F.lit(x) for f, (s, n) in overall.items() for x in (f, s / n)])
    all_folds = F.array(*[F.lit(f) for f in overall])
    others = cells.select("_category", F.explode(F.array_remove(all_folds, F.col("_fold"))).alias("_fold"), "s", "n").groupBy("_category", "_fold").agg((F.sum("s") / F.sum("n")).alias("_value"))
    small = cells.count() <= BROADCAST_STATES
    others = F.broadcast(others) if small else others
    df = rows.df.join(others, rows.df[category].eqNullSafe(others["_category"]) & (rows.df["fold"] == others["_fold"]), "left")
    df = df.withColumn(output, F.coalesce("_value", F.element_at(means, F.col("fold")))).drop("_category", "_fold", "_value")
    return rows.with_df(df, features=(*rows.features, output))


class CrossFitted(FeatureMap):
    """Out-of-fold target means for the fitting rows, all rows' means for serving; `then` is a transform fitted on the result within each fold."""

    def __init__(self, category: str, output: str = "encoded", folds: int = 5, then: Transform | None = None):
        self.category, self.output, self.folds = category, output, folds
        self.then = then
        self.name = f"cross-fitted:{category}:{folds}" + (f">{then.name}" if then else "")

    def fit_encode(self, rows: Rows, seed: int) -> tuple[Stage, Rows]:
        plan = k_fold(rows, self.folds, seed)
        encoded = out_of_fold(plan, self.category, self.output)
        serving = serving_state(rows, self.category, self.output)
        if not self.then:
            return serving, encoded.with_df(encoded.df.drop("fold"))
        after = self.then.fit(rows.with_df(serving.apply(rows.df), features=(self.output,)), seed)
        names = (*rows.features, *(after.features or (self.output,)))
        done = then_in_folds(plan, encoded, self.category, self.output, self.then, seed)
        return Chained(serving, after, names), done.with_df(done.df.drop("fold"), features=names)


@dataclass(frozen=True)
class Chained(Stage):
    first: Stage
    second: Stage
    features: tuple[str, ...] = ()
    name: str = "chained"

    def apply(self, df: DataFrame) -> DataFrame:
        return self.second.apply(self.first.apply(df))

    def record(self) -> dict:
        return {"first": self.first.record(), "second": self.second.record()}


@dataclass(frozen=True)
class ByFold(Stage):
    """A stage with its own parameters for each fold: one projection, in which a row's fold chooses. Rows of other folds get nulls."""

    stages: dict[int, Scaled]
    fold: str = "fold"
    name: str = "by-fold"

    @property
    def features(self) -> tuple[str, ...]:
        return next(iter(self.stages.values())).features

    def outputs(self) -> dict[str, Column]:
        of = lambda values: F.element_at(F.create_map(*[F.lit(x) for k, v in values for x in (k, float(v))]), F.col(self.fold))
        out = {}
        for i, f in enumerate(self.features):
            x = F.col(f).cast("double")
            if next(iter(self.stages.values())).mean is not None:
                x = x - of([(k, s.mean[i]) for k, s in self.stages.items()])
            out[f] = x * of([(k, s.inverse[i]) for k, s in self.stages.items()])
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.outputs())

    def record(self) -> dict:
        return {"stages": {str(k): s.record() for k, s in self.stages.items()}}


def fold_moments(plan: Plan, category: str, output: str) -> dict[int, Moments]:
    """For each fold the moments of its analysis rows' codes, when the encoder is fitted on these rows and encodes them.

    An analysis row's code is its category's mean over the analysis rows, so the moments follow from the cells' sums and
    counts: one pass over the rows for all folds, two aggregates of the cells, one row a fold on the driver.
    """
    y = F.col(plan.rows.target).cast("double")
    cells = plan.rows.df.groupBy(F.col(category).alias("_category"), F.col("fold").alias("_fold")).agg(F.sum(y).alias("s"), F.count(F.lit(1)).alias("n"))
    folds = F.array(*[F.lit(f) for f in range(plan.folds)])
    analysis = cells.select("_category", F.explode(F.array_remove(folds, F.col("_fold"))).alias("_fold"), "s", "n").groupBy("_category", "_fold").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).withColumn("v", F.col("s") / F.col("n"))
    analysis = written(analysis)
    first = {r["_fold"]: r for r in analysis.groupBy("_fold").agg((F.sum("s") / F.sum("n")).alias("m"), F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}
    m = F.create_map(*[F.lit(x) for k, r in first.items() for x in (k, r["m"])])
    spread = analysis.groupBy("_fold").agg((F.sum(F.col("n") * (F.col("v") - F.element_at(m, F.col("_fold"))) ** 2) / F.sum("n")).alias("d")).collect()
    return {r["_fold"]: Moments(first[r["_fold"]]["n"], (first[r["_fold"]]["m"],), (r["d"],), (first[r["_fold"]]["low"],), (first[r["_fold"]]["high"],), (output,)) for r in spread}


def then_in_folds(plan: Plan, encoded: Rows, category: str, output: str, then: Transform, seed: int) -> Rows:
    """Out-of-fold values as each fold's own transform gives them out: for fold k, `then` is fitted on the other folds' rows, encoded by these rows' means, and applied to fold k.

    Transforms that need only moments are fitted for all folds from one pass and applied in one projection; maps need no fit. Any other
    transform is fitted fold by fold, as what it reads isn't known.
    """
    if isinstance(then, Mapped):
        return encoded.with_df(then.stage.apply(encoded.df))
    if hasattr(then, "from_moments"):
        stage = ByFold({k: then.from_moments(m) for k, m in fold_moments(plan, category, output).items()})
        return encoded.with_df(stage.apply(encoded.df))
    parts = []
    for k in range(plan.folds):
        rest = plan.rows.with_df(plan.rows.df.where(F.col("fold") != k), role=Role.TRAIN)
        state = serving_state(rest, category, output)
        stage = then.fit(rest.with_df(state.apply(rest.df), features=(output,)), seed)
        parts.append(stage.apply(encoded.df.where(F.col("fold") == k)))
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part)
    return encoded.with_df(df)


def scale_in_folds(plan: Plan, encoded: Rows, category: str, output: str) -> Rows:
    """Standardise out-of-fold values as each fold's own encoder would scale its analysis rows (see `fold_moments`)."""
    return then_in_folds(plan, encoded, category, output, StandardScaler(), 0)


class MeanTarget(FeatureMap):
    """The overall mean target, out of fold for fitting rows: a category that all rows share."""

    name = "mean-target"

    def __init__(self, output: str = "mean_target", folds: int = 5):
        self.output, self.folds = output, folds

    def fit_encode(self, rows: Rows, seed: int) -> tuple[Stage, Rows]:
        whole = rows.with_df(rows.df.withColumn("_all", F.lit(1)))
        stage, encoded = CrossFitted("_all", self.output, self.folds).fit_encode(whole, seed)
        return Chained(AllRows(), stage, stage.features), encoded


class AllRows(Stage):
    name = "all-rows"

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_all", F.lit(1))
