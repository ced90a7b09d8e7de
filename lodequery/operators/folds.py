"""Ordered folds over keyed rows: what depends on all rows before, in their order.

Rows are brought together by key, sorted within the partition and streamed through Python batch by batch; only the
state of the key at hand is held, so a key of any number of rows needs no more memory than one. What a fold makes of a row
depends on all rows of its key before it, so one key is one task's work; only the last value of a clamped sum
(:func:`clamped_totals`) is put together from parts, for clamps in sequence are one clamp.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}


def fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable[..., Any], step: Callable[..., tuple[Any, Any]], out: str, out_type: str) -> DataFrame:
    """``df`` with a column ``out``: for each row in ``order``, what ``step(state, *values)`` gives besides the next state.
    ``values`` are the row's ``columns``; a key's first state is ``start(*values)`` of its first row."""
    spark = df.sparkSession
    schema = spark.createDataFrame([], f"`{out}` {out_type}").schema
    full = StructType([*df.schema.fields, schema[0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            made = []
            held = zip(*(b.column(k).to_pylist() for k in keys))
            for key, values in zip(held, zip(*(b.column(c).to_pylist() for c in columns))):
                if key != last:
                    last, state = key, start(*values)
                state, value = step(state, *values)
                made.append(value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, _ARROW[out_type])], [*b.schema.names, out])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, full)


def sliding_admissions(df: DataFrame, key: str, at_ms: str, limit: int | str, order: list[str], window_ms: int = 60_000, out: str = "admitted") -> DataFrame:
    """Whether a call is within the limit of calls *admitted* in the window before it; refused calls don't count. ``limit``
    is a number, or the column that has a key's."""

    def step(state: deque, at: int, most: int):
        while state and at - state[0] >= window_ms:
            state.popleft()
        if len(state) >= most:
            return state, False
        state.append(at)
        return state, True

    if isinstance(limit, str):
        return fold(df, [key], order, [at_ms, limit], lambda *_: deque(), step, out, "boolean")
    return fold(df, [key], order, [at_ms], lambda *_: deque(), lambda state, at: step(state, at, limit), out, "boolean")


def fixed_window_admissions(df: DataFrame, key: str, at_ms: str, limit: int, order: list[str], window_ms: int = 10_000, out: str = "admitted") -> DataFrame:
    """Whether a call is among the first ``limit`` of its window; a window opens with the first call after the last one's end."""

    def step(state: tuple, at: int):
        opened, n = state
        if opened is None or at - opened >= window_ms:
            opened, n = at, 0
        return (opened, n + 1), n < limit

    return fold(df, [key], order, [at_ms], lambda *_: (None, 0), step, out, "boolean")


def clamped_sum(df: DataFrame, key: str, delta: str, order: list[str], start: float, low: float, high: float, out: str = "score") -> DataFrame:
    """The running sum of deltas, kept between low and high after each."""

    def step(state: float, change: float | None):
        state = min(high, max(low, state + (change or 0.0)))
        return state, state

    return fold(df, [key], order, [delta], lambda *_: float(start), step, out, "double")


def clamped_totals(df: DataFrame, key: str, delta: str, order: list[str], start: float, low: float, high: float, out: str = "score") -> DataFrame:
    """``<key>, <out>``: the last value of :func:`clamped_sum` of each key.

    Rows are cut into ranges of (key, order), so a key of many rows is spread. Each part of a key is folded to the three
    numbers of x -> min(b, max(a, x + c)); a key has no more parts than there are partitions, and they are folded at the end.
    ``order`` must tell the rows of a key apart.
    """
    rows = df.select(key, *order, F.coalesce(F.col(delta).cast("double"), F.lit(0.0)).alias("_delta"))
    schema = StructType([*rows.schema.fields[:-1], *df.sparkSession.createDataFrame([], "a double, b double, c double").schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Any = None  # the key at hand, its first row, and its numbers

        def row() -> pa.RecordBatch:
            first, a, b, c = held[1:]
            return pa.RecordBatch.from_arrays([*first.columns[:-1], pa.array([a]), pa.array([b]), pa.array([c])], schema.names)

        for batch in batches:
            for i, (k, d) in enumerate(zip(batch.column(key).to_pylist(), batch.column("_delta").to_pylist())):
                if held is None or held[0] != k:
                    if held is not None:
                        yield row()
                    held = [k, batch.slice(i, 1), low, high, 0.0]
                held[2], held[3], held[4] = min(high, max(low, held[2] + d)), min(high, max(low, held[3] + d)), held[4] + d
        if held is not None:
            yield row()

    parts = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(run, schema)
    listed = F.array_sort(F.collect_list(F.struct(*order, "a", "b", "c")))
    folded = F.aggregate(listed, F.lit(float(start)), lambda x, p: F.least(p["b"], F.greatest(p["a"], x + p["c"])))
    return parts.groupBy(key).agg(folded.alias(out))
