"""Feature coordinates: ordered doubles read from numeric columns, with the first bad value found in one pass."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.functions.hashing import fnv1a, framed, hex16
from foldwise.sources.rows import DataError, Rows

NUMERIC = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType)
#: Least and greatest values of the integral types.
RANGES = {T.ByteType: (-(1 << 7), (1 << 7) - 1), T.ShortType: (-(1 << 15), (1 << 15) - 1), T.IntegerType: (-(1 << 31), (1 << 31) - 1), T.LongType: (-(1 << 63), (1 << 63) - 1)}


def check_schema(df: DataFrame, features: tuple[str, ...]) -> None:
    """Features are numbers: strings, booleans, decimals and the like are refused."""
    if not features:
        raise DataError("NoFeatures")
    for f in features:
        if not isinstance(df.schema[f].dataType, NUMERIC):
            raise DataError("UnsupportedFeatureType", f"{f}: {df.schema[f].dataType.simpleString()}")


def descriptor(df: DataFrame, features: tuple[str, ...]) -> dict:
    """The ordered names and types of a view, and a digest of them that identifies it."""
    fields = [[f, df.schema[f].dataType.simpleString()] for f in features]
    return {"fields": fields, "digest": hex16(fnv1a(json.dumps(fields).encode()))}


def exact_long(c: str | Column) -> Column:
    """Whether a long is exactly a double: what its magnitude has beyond 53 bits must be zeros. (Casting there and back isn't a test: the greatest long rounds to 2**63.)"""
    c = F.col(c) if isinstance(c, str) else c
    size = F.when(c == F.lit(-(1 << 63)), F.lit(1).cast("long")).otherwise(F.abs(F.when(c == F.lit(-(1 << 63)), F.lit(0)).otherwise(c)))
    return reduce(lambda rest, k: F.when(size >= F.lit(1 << 53 + k - 1), F.pmod(size, F.lit(1 << k)) == 0).otherwise(rest), range(1, 11), F.lit(True))


def coordinate(df: DataFrame, f: str) -> Column:
    return F.col(f).cast("double")


def problem(df: DataFrame, f: str) -> Column:
    """The code of what is wrong with a coordinate, or null."""
    c, kind = F.col(f), df.schema[f].dataType
    bad = F.when(c.isNull(), "Missing")
    if isinstance(kind, T.LongType):
        return bad.when(~exact_long(f), "LossyConversion")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return bad.when(F.isnan(c) | (F.abs(c) == float("inf")), "NonFinite")
    return bad


def problems(rows: Rows, extra: tuple[str, ...] = ()) -> Column:
    """The first bad coordinate of a row, by the features' order, as (index, name, code); null for a good row."""
    found = [F.when(problem(rows.df, f).isNotNull(), F.struct(F.lit(i).alias("index"), F.lit(f).alias("name"), problem(rows.df, f).alias("code"))) for i, f in enumerate((*rows.features, *extra))]
    return F.coalesce(*found)


def first_problem(rows: Rows) -> DataFrame:
    """(row id, index, name, code) of the bad row with the least id; no row if all are good. One aggregate, no sort."""
    check_schema(rows.df, rows.features)
    bad = rows.df.select(F.col(rows.row_id).alias("row_id"), problems(rows).alias("p")).where("p is not null")
    return bad.agg(F.min(F.struct("row_id", "p")).alias("m")).where("m is not null").select("m.row_id", "m.p.index", "m.p.name", "m.p.code")


def build(values: Column, kind: T.DataType) -> tuple[Column, Column]:
    """A double turned back into a feature of another type: (value, error code). Out of range comes before not integral; a float must hold the value exactly."""
    finite = ~(F.isnan(values) | (F.abs(values) == float("inf")))
    if isinstance(kind, T.DoubleType):
        return values, F.when(values.isNull(), "Missing")
    if isinstance(kind, T.FloatType):
        inside = F.abs(values) <= 3.4028234663852886e38
        error = F.when(values.isNull(), "Missing").when(finite & ~inside, "OutOfRange").when(finite & (values.cast("float").cast("double") != values), "LossyConversion")
        return F.when(error.isNull(), values.cast("float")), error
    low, high = RANGES[type(kind)]
    inside = finite & (values >= float(low)) & ((values < float(high)) if isinstance(kind, T.LongType) else (values <= float(high)))
    error = F.when(values.isNull(), "Missing").when(~inside, "OutOfRange").when(F.floor(F.when(inside, values)) != values, "InvalidIntegral")
    return F.when(error.isNull(), values).cast(kind), error


def dense(rows: Rows, name: str = "features") -> DataFrame:
    """The frame with all coordinates as one array of doubles."""
    return rows.df.withColumn(name, F.array(*[coordinate(rows.df, f) for f in rows.features]))


def check_dense(df: DataFrame, name: str, size: int) -> DataFrame:
    """(code, n) of vectors that aren't `size` numbers."""
    v = F.col(name)
    code = F.when(v.isNull(), "Missing").when(F.size(v) != size, "DimensionMismatch").when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "NonFinite")
    return df.select(code.alias("code")).where("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class FeatureSchema:
    """The names of a vector's coordinates in order: some, not blank, each once. The digest identifies them."""

    names: tuple[str, ...]

    def __post_init__(self) -> None:
        if not self.names:
            raise DataError("NoFeatures")
        if len(set(self.names)) != len(self.names) or any(not n.strip() for n in self.names):
            raise DataError("InvalidFeatureNames", ", ".join(self.names[:5]))

    @property
    def digest(self) -> str:
        return hex16(fnv1a(b"".join(map(framed, ("feature-schema-v1", *self.names)))))


@dataclass(frozen=True)
class Sparse:
    """Rows of which few coordinates aren't zero, less a point `at`, as a matrix: products with vectors never write the zeros out."""

    row: np.ndarray
    index: np.ndarray
    value: np.ndarray
    many: int
    at: np.ndarray

    __array_ufunc__ = None  # a vector times the rows comes to __rmatmul__

    def __len__(self) -> int:
        return self.many

    def __sub__(self, point: np.ndarray) -> Sparse:
        return replace(self, at=self.at + point)

    def __matmul__(self, c: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * c[self.index], minlength=self.many) - self.at @ c

    def __rmatmul__(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, weights=self.value * v[self.row], minlength=len(self.at)) - v.sum() * self.at

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        out = np.zeros((self.many, len(self.at)))
        out[self.row, self.index] = self.value
        return out - self.at


#: What the column of a sparse view holds: places in ascending order, from 0, and their values; other places hold zeros.
SPARSE = T.StructType([T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))])


@dataclass(frozen=True)
class View:
    """The coordinates that a fit reads from each row: named numeric columns, or one vector column with a schema, written out or sparse."""

    names: tuple[str, ...]
    column: str | None = None
    sparse: bool = False

    @classmethod
    def vector(cls, df: DataFrame, column: str, schema: FeatureSchema | None = None, size: int | None = None) -> View:
        """A vector column as coordinates; without a schema they are called by their places."""
        kind = df.schema[column].dataType
        if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, NUMERIC)):
            raise DataError("UnsupportedFeatureType", f"{column}: {kind.simpleString()}")
        if schema is None:
            if not size or size < 1:
                raise DataError("NoFeatures")
            schema = FeatureSchema(tuple(f"{column}[{i}]" for i in range(size)))
        return cls(schema.names, column)

    @classmethod
    def of_sparse(cls, df: DataFrame, column: str, size: int) -> View:
        """A column of `indices` and `values` (see SPARSE) as `size` coordinates, called by their places."""
        if not size or size < 1:
            raise DataError("NoFeatures")
        view = cls(tuple(f"{column}[{i}]" for i in range(size)), column, True)
        view.check(df)
        return view

    def __len__(self) -> int:
        return len(self.names)

    def descriptor(self, df: DataFrame) -> dict:
        """Names, types and digest; `build` of these gives the frame's values back."""
        if self.column is None:
            return descriptor(df, self.names)
        return {"column": self.column, "type": df.schema[self.column].dataType.simpleString(), "size": len(self), "digest": FeatureSchema(self.names).digest}

    def check(self, df: DataFrame) -> None:
        if self.column is None:
            check_schema(df, self.names)
        elif self.sparse:
            kind = df.schema[self.column].dataType
            if not isinstance(kind, T.StructType) or [(f.name, type(f.dataType), type(getattr(f.dataType, "elementType", None))) for f in kind] != [(f.name, T.ArrayType, type(f.dataType.elementType)) for f in SPARSE]:
                raise DataError("UnsupportedFeatureType", f"{self.column}: {kind.simpleString()}")
        elif not isinstance(df.schema[self.column].dataType, T.ArrayType):
            raise DataError("UnsupportedFeatureType", self.column)

    def written_out(self) -> None:
        """Refuse a sparse view where every coordinate is needed as a number of its own."""
        if self.sparse:
            raise DataError("UnsupportedFeatureType", f"{self.column}: sparse")

    def columns(self, df: DataFrame) -> list[Column]:
        """What to select for `matrix`: doubles, one array of doubles, or places and values."""
        if self.sparse:
            return [F.col(self.column)[k].alias(f"_{k}") for k in ("indices", "values")]
        if self.column is not None:
            return [F.col(self.column).cast("array<double>").alias("_v")]
        return [coordinate(df, f).alias(f"_v{i}") for i, f in enumerate(self.names)]

    def matrix(self, batch: pa.RecordBatch, first: int) -> np.ndarray:
        """The rows of an Arrow batch whose columns from `first` on are those of `columns`, written straight into one matrix."""
        if self.sparse:
            return np.asarray(self.rows(batch, first))
        if self.column is not None:
            return batch.column(first).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), len(self))
        out = np.empty((len(batch), len(self)))
        for i in range(len(self)):
            out[:, i] = batch.column(first + i).to_numpy(zero_copy_only=False)
        return out

    def rows(self, batch: pa.RecordBatch, first: int) -> np.ndarray | Sparse:
        """The same, sparse rows as they are."""
        if not self.sparse:
            return self.matrix(batch, first)
        places, values = batch.column(first), batch.column(first + 1)
        many = np.diff(places.offsets.to_numpy())
        return Sparse(np.repeat(np.arange(len(batch)), many), places.flatten().to_numpy(), values.flatten().to_numpy(), len(batch), np.zeros(len(self)))

    def problem(self, rows: Rows) -> Column:
        """The first bad coordinate as (index, name, code), or null; a vector that is missing, of another size, or sparse with bad places comes first, at index -1."""
        if self.column is None:
            return problems(rows)
        v = F.col(self.column)
        if self.sparse:
            return self._sparse_problem(v["indices"], v["values"])
        bad = F.array_position(F.transform(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), True)
        of = lambda i, name, code: F.struct(i.cast("int").alias("index"), name.alias("name"), F.lit(code).alias("code"))
        whole = F.lit(self.column)
        return F.when(v.isNull(), of(F.lit(-1), whole, "Missing")).when(F.size(v) != len(self), of(F.lit(-1), whole, "DimensionMismatch")).when(bad > 0, of(bad - 1, F.element_at(F.lit(list(self.names)), bad.cast("int")), "NonFinite"))

    def _sparse_problem(self, places: Column, values: Column) -> Column:
        of = lambda i, name, code: F.struct(i.cast("int").alias("index"), name.alias("name"), F.lit(code).alias("code"))
        whole = lambda code: of(F.lit(-1), F.lit(self.column), code)
        # ascending from before the first place: what isn't becomes the size, which nothing exceeds
        last = F.aggregate(places, F.lit(-1), lambda a, i: F.when((i > a) & (i < len(self)), i).otherwise(len(self)))
        bad = F.array_position(F.transform(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), True)
        at = F.element_at(places, F.when(bad > 0, bad.cast("int")))
        sized = F.when(places.isNull() | values.isNull(), whole("Missing")).when(F.size(places) != F.size(values), whole("DimensionMismatch"))
        return sized.when(last >= len(self), whole("InvalidIndex")).when(bad > 0, of(at, F.concat(F.lit(f"{self.column}["), at.cast("string"), F.lit("]")), "NonFinite"))


def vectors(df: DataFrame, view: View, keep: tuple[str, ...] = (), name: str = "features") -> DataFrame:
    """The columns `keep` and the view's coordinates as one array of doubles."""
    view.written_out()
    return df.select(*keep, view.columns(df)[0].alias(name) if view.column else F.array(*view.columns(df)).alias(name))


def named_columns(df: DataFrame, view: View) -> DataFrame:
    """A vector column taken apart into a column for each of its coordinates: the inverse of `vectors`."""
    view.written_out()
    return df.withColumns({n: F.get(F.col(view.column), i).cast("double") for i, n in enumerate(view.names)})


@dataclass(frozen=True)
class Isomorphic:
    """Rows of another shape seen through a view: `to` gives the view's coordinates from the other shape's columns, `back` these columns from the coordinates."""

    view: View
    to: dict[str, Column]
    back: dict[str, Column]

    def __post_init__(self) -> None:
        if self.view.column is not None or set(self.to) != set(self.view.names):
            raise DataError("InvalidFeatureNames", ", ".join(sorted(set(self.to) ^ set(self.view.names))) or str(self.view.column))
        if both := set(self.back) & set(self.to):
            raise DataError("ClashingColumns", ", ".join(sorted(both)))

    def read(self, df: DataFrame) -> DataFrame:
        """The frame with the view's coordinates in place of the other shape's columns."""
        if both := [n for n in self.to if n in df.columns]:
            raise DataError("ClashingColumns", ", ".join(both))
        return df.select("*", *[c.alias(n) for n, c in self.to.items()]).drop(*self.back)

    def build(self, df: DataFrame) -> DataFrame:
        """The other shape's columns in place of the coordinates: what `read` takes, if both directions agree."""
        return df.select("*", *[c.alias(n) for n, c in self.back.items()]).drop(*self.to)

    def broken(self, df: DataFrame) -> DataFrame:
        """The rows of `df` that don't come back as they were."""
        kept = df.select(*df.columns, F.struct(*self.back).alias("_was"))
        again = self.build(self.read(kept))
        return again.where(~F.struct(*self.back).eqNullSafe(F.col("_was"))).select(*df.columns)
