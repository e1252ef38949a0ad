"""Keyed rows: a DataFrame with a stable row id, a role that says what may learn from it, and an identity."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from enum import Enum

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions.digests import ordered_digest
from foldwise.functions.hashing import Fingerprint
from foldwise.operators.state import global_position, skew_join


class DataError(ValueError):
    """Rows that break a rule; `code` says which."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


class Role(Enum):
    UNSPLIT = "unsplit"
    TRAIN = "train"
    REFIT = "refit"
    VALIDATION = "validation"
    TEST = "test"

    @property
    def fits(self) -> bool:
        return self in (Role.TRAIN, Role.REFIT)

    @property
    def evaluates(self) -> bool:
        return self in (Role.VALIDATION, Role.TEST)


@dataclass(frozen=True)
class Rows:
    """A frame and the names of its parts. Roles can't be changed but by the operators that split or join rows lawfully."""

    df: DataFrame
    row_id: str
    features: tuple[str, ...] = ()
    target: str | None = None
    weight: str | None = None
    group: str | None = None
    time: str | None = None
    fingerprint: Fingerprint = field(default=Fingerprint("summary", ("undeclared",), "none"))
    role: Role = Role.UNSPLIT

    def __post_init__(self) -> None:
        named = [self.row_id, *self.features, *(x for x in (self.target, self.weight, self.group, self.time) if x)]
        if missing := [c for c in named if c not in self.df.columns]:
            raise DataError("UnknownColumn", ", ".join(missing))
        if len(set(self.features)) != len(self.features) or any(not f.strip() for f in self.features):
            raise DataError("InvalidFeatureNames", ", ".join(self.features))

    def with_df(self, df: DataFrame, **changes) -> Rows:
        return replace(self, df=df, **changes)

    def fitting(self) -> Rows:
        """Itself, if a model may be fitted on it."""
        if not self.role.fits:
            raise DataError("NotFitData", self.role.value)
        return self

    def non_empty(self) -> Rows:
        if not self.df.limit(1).count():
            raise DataError("EmptyData")
        return self

    def count(self) -> int:
        return self.df.count()

    def batches(self, size: int, f: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
        """Apply f to chunks of at most `size` rows inside the tasks."""
        if size < 1:
            raise DataError("InvalidBatchSize", str(size))

        def run(got):
            for batch in got:
                for lo in range(0, len(batch), size):
                    yield from f(batch.slice(lo, size))

        return self.df.mapInArrow(run, schema)


def unsplit(df: DataFrame, row_id: str, fingerprint: Fingerprint | None = None, **parts) -> Rows:
    """Declare a frame whose rows `row_id` identifies. Without a fingerprint its identity is a summary of its ids."""
    if fingerprint is None:
        fingerprint = ids_fingerprint(df, row_id)
    return Rows(df, row_id, fingerprint=fingerprint, **parts)


def numbered(df: DataFrame, order: list[Column], name: str = "row_id") -> DataFrame:
    """Give rows without a key their 0-based position in a total order."""
    return global_position(df, order, name)


def from_pairs(spark: SparkSession, pairs: list[tuple[tuple[float, ...], float]], features: tuple[str, ...]) -> Rows:
    """Examples given on the driver; ids are their positions."""
    rows = [(i, *map(float, x), float(y)) for i, (x, y) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "row_id long, " + ", ".join(f"`{f}` double" for f in features) + ", target double")
    digest = hashlib.sha256(repr(rows).encode()).hexdigest()
    return unsplit(df, "row_id", Fingerprint("content-digest", ("sha256",), digest), features=features, target="target")


def paired(df: DataFrame, features: dict[str, Column], target: Column, order: list[Column], fingerprint: Fingerprint | None = None) -> Rows:
    """Pairs of inputs and a target that a frame holds without a key: ids are their positions in a total order."""
    df = numbered(df, order).select("row_id", *[c.cast("double").alias(f) for f, c in features.items()], target.cast("double").alias("target"))
    return unsplit(df, "row_id", fingerprint, features=tuple(features), target="target")


def read_parquet(spark: SparkSession, path: str, row_id: str, version: str = "1", **parts) -> Rows:
    """A Parquet table as unsplit rows, identified by its path and version."""
    return unsplit(spark.read.parquet(path), row_id, Fingerprint("source-identity", (path, version), "parquet"), **parts)


def ids_fingerprint(df: DataFrame, row_id: str) -> Fingerprint:
    """An order-free summary of the row ids: count, exclusive or and sum of their hashes, all mergeable in any order."""
    h = F.xxhash64(row_id)
    r = df.agg(F.count(row_id).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return Fingerprint("summary", ("row-ids-v1",), f"{r['n']}:{r['x'] or 0}:{r['s'] or 0}")


def ordered_fingerprint(df: DataFrame, row_id: str, columns: tuple[str, ...] = ()) -> Fingerprint:
    """A digest of the rows (the id and other columns) in ascending order of the id: the same for every partitioning, another one if two rows change places or anything in them changes."""
    kept = [row_id, *(c for c in columns if c != row_id)]
    return ordered_digest(global_position(df.select(*kept), [F.col(row_id)]), kept).fingerprint()


def duplicate_ids(df: DataFrame, row_id: str, order: str | None = None) -> DataFrame:
    """(row_id, n, at) of each id that occurs more than once, with its second position where `order` gives positions."""
    if not order:
        return df.groupBy(row_id).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("at")).where("n > 1")
    first = df.groupBy(row_id).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first")).where("n > 1")
    later = skew_join(df.select(row_id, F.col(order).alias("_at")), first, [row_id]).where("_at > _first")
    return later.groupBy(row_id).agg(F.first("n").alias("n"), F.min("_at").alias("at"))


def require_unique(df: DataFrame, row_id: str) -> int:
    """The number of rows, if no id is null or repeated. Ids are counted by partial aggregates; one group comes back."""
    r = df.groupBy(row_id).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.max("n").alias("most"), F.min(F.when(F.col("n") > 1, F.col(row_id))).alias("first"), F.max(F.col(row_id).isNull().cast("int")).alias("null")).first()
    if r["null"]:
        raise DataError("NullRowId")
    if (r["most"] or 0) > 1:
        raise DataError("DuplicateRowId", str(r["first"]))
    return r["rows"] or 0


def restore_check(original: DataFrame, prepared: DataFrame, row_id: str) -> DataFrame:
    """(code, n): what keeps `prepared` from standing for `original` row by row; no rows if nothing does."""
    a = original.groupBy(row_id).agg(F.count(F.lit(1)).alias("a"))
    b = prepared.groupBy(row_id).agg(F.count(F.lit(1)).alias("b"))
    code = (
        F.when(F.col("a") > 1, "DuplicateInputRow").when(F.col("b") > 1, "DuplicatePreparedRow")
        .when(F.col("a").isNull(), "UnknownPreparedRow").when(F.col("b").isNull(), "MissingPreparedRow")
    )
    return a.join(b, row_id, "full_outer").select(code.alias("code")).where("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def overlap(fitted: DataFrame, held_out: DataFrame, row_id: str) -> DataFrame:
    """The held-out ids that the fitted rows hold too."""
    return held_out.join(fitted.select(row_id), row_id, "left_semi").select(row_id)
