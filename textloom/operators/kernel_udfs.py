"""Kernels as Arrow functions over columns: compiled once a task, and mapped over a few rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, _parse_datatype_string

#: Rows that are Python objects at a time, and about the bytes of results that are sent at once: so a worker's memory does not
#: depend on how many rows a batch has, only on the longest rows.
ROWS, SENT = 64, 4 << 20


def kernel(fn: Callable, returns: str) -> Callable[..., Column]:
    """A column function that maps fn over rows; a row with a null first argument gives null.

    fn takes Python values, a numpy array for an array of longs, and returns what ``returns`` (a DDL type) describes: a dict for a struct.
    Spark is told that it is not deterministic, as it computes what filters or generators read a second time otherwise: below them, to drop rows early.
    """

    kind: DataType | None = None
    arrow: pa.DataType | None = None

    def batch(*columns: pa.Array) -> Iterator[pa.Array]:
        made, size = [], 0
        for at in range(0, len(columns[0]), ROWS):
            values = [_values(c.slice(at, ROWS)) for c in columns]
            made.append(pa.array([None if row[0] is None else fn(*row) for row in zip(*values)], type=arrow))
            size += made[-1].nbytes
            if size >= SENT:
                yield pa.concat_arrays(made)
                made, size = [], 0
        if made:
            yield pa.concat_arrays(made)

    def udf(n: int):
        nonlocal kind, arrow
        if kind is None:
            kind = _parse_datatype_string(returns)
            arrow = to_arrow_type(kind)
        return F.arrow_udf(_with_arity(batch, n), returnType=kind).asNondeterministic()

    def call(*columns: Column) -> Column:
        return udf(len(columns))(*columns)

    call.udf = udf  # the function of so many columns, to be registered for SQL
    return call


def _values(rows: pa.Array) -> list:
    if not (pa.types.is_list(rows.type) and pa.types.is_int64(rows.type.value_type)) or rows.null_count or not len(rows):
        return rows.to_pylist()
    flat, ends = rows.flatten().to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
    return [flat[a - ends[0] : b - ends[0]] for a, b in zip(ends, ends[1:])]


def _with_arity(batch: Callable, n: int) -> Callable:
    """Arrow functions are told by their annotated parameters."""
    if n == 1:

        def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for a in batches:
                yield from batch(a)

        return one

    def two(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield from batch(a, b)

    return two


def names(columns: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]
