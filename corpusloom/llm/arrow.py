"""Rows of Arrow batches: keys that pass untouched, and bytes of many texts in a row."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import wraps
from types import ModuleType

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

KEPT = "corpusloom_kept"


def remembered(fn: Callable) -> Callable:
    """Results of `fn` by its arguments, kept for the process. The store is found by name, so that it goes with no function
    that is sent to the workers and serves all tasks of one."""

    @wraps(fn)
    def run(*args):
        kept = vars(sys.modules.setdefault(KEPT, ModuleType(KEPT))).setdefault(f"{fn.__module__}.{fn.__qualname__}", {})
        if args not in kept:
            kept[args] = fn(*args)
        return kept[args]

    return run


def raw_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values of a binary column in a row, where each value ends); a null counts as empty."""
    column = column.cast(pa.binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at[1:] - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at[1:] - at[0]


def chunks(ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of values of at most `limit` bytes, or of one longer value."""
    begin = 0
    while begin < len(ends):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield begin, end
        begin = end


def cut(data: np.ndarray, ends: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The values begin … end-1 of those in `data`."""
    first = ends[begin - 1] if begin else 0
    return data[first : ends[end - 1]], ends[begin:end] - first


def map_rows(
    inputs: DataFrame, keys: list[str], start: Callable[[], Callable[[pd.DataFrame], Iterator[tuple[np.ndarray, pd.DataFrame]]]], results: str
) -> DataFrame:
    """The key columns of `inputs` and the columns `results` made from its other ones.

    `start` is called once per task and gives the function that turns a batch of the other columns into (numbers of the
    rows, their results). Keys are taken by these numbers from the Arrow batch: in pandas a null would make numbers of all
    ids of a batch doubles, which hold no large ids.
    """
    kinds = ", ".join(f"`{k}` {inputs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            others = [c for c in batch.schema.names if c not in keys]
            for rows, out in work(batch.select(others).to_pandas()):
                at = pa.array(np.asarray(rows, np.int64))
                made = pa.RecordBatch.from_pandas(out, preserve_index=False)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in keys], *made.columns], [*keys, *made.schema.names])

    return inputs.mapInArrow(run, f"{kinds}, {results}")
