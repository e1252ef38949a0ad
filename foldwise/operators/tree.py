"""Folds of a table to one small state: in every task, then in rounds of tasks, so that the driver gets the merged state only."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

State = dict[str, np.ndarray]
#: States that one task of a round merges.
FAN_IN = 16


def pack(state: State) -> bytes:
    out = io.BytesIO()
    np.savez(out, **state)
    return out.getvalue()


def unpack(data: bytes) -> State:
    with np.load(io.BytesIO(data)) as held:
        return {k: held[k] for k in held.files}


def added(a: State, b: State) -> State:
    return {k: a[k] + b[k] for k in a}


def tree_fold(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], dict], merge: Callable[[State, State], State] = added) -> dict:
    """{key: state} over all rows. `step` folds the batches of a task into states by key (None, a number or a string); `merge` must not depend on order."""

    def held(states: dict) -> Iterator[pa.RecordBatch]:
        if states:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(k) for k in states]), pa.array([pack(s) for s in states.values()], pa.binary())], names=["key", "state"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from held(step(batches))

    def merged(rows: Iterator[tuple[str, bytes]]) -> dict:
        out: dict = {}
        for key, data in rows:
            key, state = json.loads(key), unpack(data)
            out[key] = merge(out[key], state) if key in out else state
        return out

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from held(merged((k, s) for b in batches for k, s in zip(*(c.to_pylist() for c in b.columns))))

    schema = "key string, state binary"
    out = df.mapInArrow(first, schema)
    parts = out.rdd.getNumPartitions()
    while parts > 1:  # the last round has one task: a local iterator over more would run them one after another
        parts = -(-parts // FAN_IN)
        out = out.repartition(parts).mapInArrow(again, schema)
    return merged((r["key"], bytes(r["state"])) for r in out.toLocalIterator())
