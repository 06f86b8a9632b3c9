"""Applying a Python function to Arrow batches of a DataFrame."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Bytes of text or binary values that a Python function gets at once, unless one row has more.
SLICE_BYTES = 8 << 20


def calm_collector() -> None:
    """Collect what the last task left, then let the garbage collector run rarely: large tables without cycles follow."""
    gc.collect()
    gc.set_threshold(500_000, 20, 50)


def slices(batch: pa.RecordBatch, rows: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and ``most`` bytes of text or binary values, but at least one row."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + most, "right"))))
        yield batch.slice(at, to - at)
        at = to


def map_rows(
    df: DataFrame, make: Callable[[], Callable[..., list]], schema: str, keep: int = 0, rows: int = 512, raw: bool = False, most: int = SLICE_BYTES, inputs: list[int] | None = None
) -> DataFrame:
    """Columns computed from the rows of df, beside its first ``keep`` columns.

    ``make()`` runs once in each task and returns the function, which gets the remaining
    columns (or those with the numbers ``inputs``) of up to ``rows`` rows as Python lists
    and returns the lists of the new columns, as lists or Arrow arrays. With ``raw`` it
    gets Arrow arrays. Slices hold at
    most ``most`` bytes of text or binary values (or one row), which bounds the memory of
    a task whatever the batch size of the session and the length of the texts. ``schema``
    names the new columns.
    """
    kept = StructType(df.schema.fields[:keep])
    new = _parse_datatype_string(schema)
    full = StructType(kept.fields + new.fields)
    shape = to_arrow_schema(full)
    read = inputs if inputs is not None else list(range(keep, len(df.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, rows, most):
                found = f(*(part.column(i) if raw else part.column(i).to_pylist() for i in read))
                arrays = [part.column(i).cast(shape.field(i).type) for i in range(keep)]
                arrays += [x.cast(shape.field(keep + i).type) if isinstance(x, pa.Array) else pa.array(x, shape.field(keep + i).type) for i, x in enumerate(found)]
                yield pa.RecordBatch.from_arrays(arrays, schema=shape)

    return df.mapInArrow(run, full)


def with_columns(df: DataFrame, inputs: list[str], make: Callable[[], Callable[..., list]], schema: str, **how) -> DataFrame:
    """All columns of df and columns computed from its columns ``inputs``, by `map_rows`.

    Columns go by number meanwhile, so their names clash with nothing; a column of df that
    has the name of a new one is replaced by it.
    """
    names, new = df.columns, _parse_datatype_string(schema).names
    by_number = df.toDF(*[f"c{i}" for i in range(len(names))])
    done = map_rows(by_number, make, schema, keep=len(names), inputs=[names.index(c) for c in inputs], **how)
    return done.select(*[done[f"c{i}"].alias(c) for i, c in enumerate(names) if c not in new], *new)
