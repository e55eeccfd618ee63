"""Shared scratch space: written tables that cut lineage and outlive executors."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.session import scratch_path as scratch_path
from pairforge.session import written as written


#: A table of at most so many narrow rows may be broadcast.
BROADCAST_ROWS = 50_000


def lookup(df: DataFrame, name: str) -> DataFrame:
    """A table to join by: written, counted, and broadcast only if it is small.

    Beyond the bound Spark joins it by sort, splitting skewed keys.
    """
    table = written(df, name)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a few hundred, which bounds what a worker holds beside its input."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def bounded(batches: Iterator[pa.RecordBatch], column: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and ``size`` bytes of a text column, or of one longer text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = min(max(int(np.searchsorted(ends, before + size, "right")), begin + 1), begin + rows)
            yield batch.slice(begin, end - begin)
            begin = end


#: Rows of an Arrow batch: whole texts travel in it, so the default of 10,000 would hold far too much at once.
ARROW_ROWS = 512


def frugal(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small, as executors hold one or two of them for each task.

    Results are lazy and read the setting when they run, so it stays; it changes
    how many rows travel together and no result.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


_HELD: dict[str, Callable[[], None]] = {}
_LAST: str | None = None


def working(name: str, clear: Callable[[], None] | None = None) -> None:
    """Called by an operator's function in a worker: the caches of other operators there are dropped.

    Spark reuses Python workers, and what the last operator has cached would
    otherwise stay beside what the next one needs. What was freed goes back to
    the system, as it counts against the executor until then.
    """
    global _LAST
    for other in [k for k in _HELD if k != name]:
        _HELD.pop(other)()
    if clear is not None:
        _HELD[name] = clear
    if _LAST not in (None, name):
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
            ctypes.CDLL(None).malloc_trim(0)
    _LAST = name


def keep_freed() -> None:
    """Let a worker keep some memory that it frees, for functions that make arrays of a few MB over and over.

    glibc gives freed memory back until it has seen a larger block go; every
    array would then be faulted in again page by page. The block here is never
    written, so it takes no memory; what stays is 48 MB at most.
    """
    np.empty(24 << 20, np.uint8)
