"""Fitted chains as files: an envelope with a format and a version, the audit, and each stage's payload."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.operators.encoders import AllRows, Chained, Encoded
from foldwise.operators.ridge import Model
from foldwise.operators.scalers import Scaled, ScaledVector
from foldwise.operators.stages import Audit, Fitted, Named, Stage
from foldwise.operators.state import hadoop_paths
from foldwise.sources.rows import DataError

MAGIC = "foldwise-artifact"


def check_format(name: str, version: int) -> None:
    if not re.fullmatch(r"[a-z][a-z0-9.-]*", name):
        raise DataError("InvalidFormatName", name)
    if version < 1:
        raise DataError("InvalidFormatVersion", str(version))


#: Stages that can be kept: name, version, what to write, how to read it.
CODECS: dict[type, tuple[str, int, object, object]] = {
    Scaled: ("scaled", 1, lambda s: {"features": s.features, "mean": s.mean, "inverse": s.inverse}, lambda p: Scaled(tuple(p["features"]), None if p["mean"] is None else tuple(p["mean"]), tuple(p["inverse"]))),
    AllRows: ("all-rows", 1, lambda s: {}, lambda p: AllRows()),
    Model: ("ridge", 1, lambda m: {"features": m.features, "coefficients": m.coefficients, "intercept": m.intercept, "column": m.column}, lambda p: Model(tuple(p["features"]), tuple(p["coefficients"]), p["intercept"], column=p.get("column"))),
    ScaledVector: ("scaled-vector", 1, lambda s: {"column": s.column, "mean": s.mean, "inverse": s.inverse}, lambda p: ScaledVector(p["column"], None if p["mean"] is None else tuple(p["mean"]), tuple(p["inverse"]))),
}


def register(kind: type, name: str, version: int, write, read) -> None:
    check_format(name, version)
    CODECS[kind] = (name, version, write, read)


def encode_stage(stage: Stage, tables: list | None = None) -> dict:
    """A stage's envelope. Chained stages hold their parts' envelopes; a stage with a table adds it to `tables`, if there is a place for tables."""
    if isinstance(stage, Chained):
        return {"format": "chained", "version": 1, "payload": {"first": encode_stage(stage.first, tables), "second": encode_stage(stage.second, tables), "features": stage.features}}
    if isinstance(stage, Named) and stage.sql:
        return {"format": "sql-map", "version": 1, "payload": {"label": stage.label, "version": stage.version, "sql": stage.sql}}
    if isinstance(stage, Encoded) and tables is not None:
        tables.append(stage.state)
        return {"format": "target-mean", "version": 1, "payload": {"category": stage.category, "output": stage.output, "overall": stage.overall, "small": stage.small, "features": stage.features, "table": len(tables) - 1}}
    if type(stage) not in CODECS:
        raise DataError("NoCodec", stage.name)
    name, version, write, _ = CODECS[type(stage)]
    return {"format": name, "version": version, "payload": write(stage)}


def decode_stage(given: dict, tables: list | None = None) -> Stage:
    p = given.get("payload") or {}
    nested = {
        "chained": lambda: Chained(decode_stage(p["first"], tables), decode_stage(p["second"], tables), tuple(p["features"])),
        "sql-map": lambda: Named(p["label"], p["version"], {k: F.expr(e) for k, e in p["sql"]}, tuple(map(tuple, p["sql"]))),
        "target-mean": lambda: Encoded(p["category"], p["output"], tables[p["table"]], p["overall"], p["small"], tuple(p["features"])),
    }
    if given.get("format") in nested and given.get("version") == 1 and (tables is not None or given["format"] != "target-mean"):
        return nested[given["format"]]()
    for name, version, _, read in CODECS.values():
        if given.get("format") == name:
            if given.get("version") != version:
                raise DataError("UnsupportedVersion", f"{name}@{given.get('version')}")
            return read(given["payload"])
    raise DataError("UnknownFormat", str(given.get("format")))


def _sealed(body: dict) -> str:
    text = json.dumps(body, sort_keys=True, separators=(",", ":"))
    return json.dumps({"body": body, "sha256": hashlib.sha256(text.encode()).hexdigest()}, sort_keys=True, separators=(",", ":"))


def _opened(data: bytes | str) -> dict:
    try:
        outer = json.loads(data)
        body = outer["body"]
    except (ValueError, KeyError, TypeError) as e:
        raise DataError("Malformed") from e
    if body.get("magic") != MAGIC:
        raise DataError("WrongMagic", str(body.get("magic")))
    if hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest() != outer.get("sha256"):
        raise DataError("WrongDigest")
    return body


def _body(fitted: Fitted, tables: list | None) -> dict:
    a = fitted.audit
    return {"magic": MAGIC, "audit": {"plan": a.plan, "seed": a.seed, "data": a.data, "details": a.details, "schema": a.schema}, "stages": [encode_stage(s, tables) for s in fitted.stages]}


def _fitted(body: dict, tables: list | None) -> Fitted:
    a = body["audit"]
    return Fitted(tuple(decode_stage(s, tables) for s in body["stages"]), Audit(tuple(a["plan"]), a["seed"], a["data"], tuple(a["details"]), a.get("schema", "")))


def encode(fitted: Fitted) -> bytes:
    """A chain without tables as canonical JSON with its digest; floats come back bit by bit."""
    return _sealed(_body(fitted, None)).encode()


def decode(data: bytes) -> Fitted:
    return _fitted(_opened(data), None)


def save(fitted: Fitted, spark: SparkSession, path: str) -> None:
    """A chain as a folder: its manifest, and a Parquet table for the state of each encoder, whatever its size.

    Everything is written beside `path` first; one rename publishes it. An existing folder is never overwritten.
    """
    tables: list[DataFrame] = []
    body = _body(fitted, tables)
    part = f"{path.rstrip('/')}.part-{uuid.uuid4().hex}"
    body["tables"] = []
    for i, df in enumerate(tables):
        df.write.parquet(f"{part}/tables/{i}")
        body["tables"].append({"schema": df.schema.json(), "rows": spark.read.parquet(f"{part}/tables/{i}").count()})
    spark.createDataFrame([(_sealed(body),)], "value string").coalesce(1).write.text(f"{part}/manifest")
    fs, (source, target) = hadoop_paths(spark, part, path)
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)
        raise DataError("TargetExists", path)


def load(spark: SparkSession, path: str) -> Fitted:
    """A chain from its folder. A folder without a whole manifest, or whose tables lack rows or have other columns than it says, is refused."""
    fs, (folder, manifest) = hadoop_paths(spark, path, f"{path.rstrip('/')}/manifest/_SUCCESS")
    if not fs.exists(manifest):
        raise DataError("Incomplete", path)
    body = _opened("".join(r[0] for r in spark.read.text(f"{path}/manifest", wholetext=True).collect()).strip())
    tables = []
    for i, said in enumerate(body.get("tables", [])):
        at = f"{path.rstrip('/')}/tables/{i}"
        if not fs.exists(hadoop_paths(spark, f"{at}/_SUCCESS")[1][0]):
            raise DataError("Incomplete", at)
        df = spark.read.schema(T.StructType.fromJson(json.loads(said["schema"]))).parquet(at)
        if df.count() != said["rows"] or spark.read.parquet(at).columns != df.columns:
            raise DataError("Incomplete", at)
        tables.append(df)
    return _fitted(body, tables)
