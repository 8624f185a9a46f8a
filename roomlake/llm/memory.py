"""What Python workers give back between tasks.

Workers live on after a task and may serve any operator next. What one leaves
behind counts against the executor, so tasks end by returning it to the system.
"""

from __future__ import annotations

import ctypes
import functools
import gc

import pyarrow as pa


def give_back() -> None:
    """Return memory that Python, Arrow and the C library hold but don't use."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def releasing(run):
    """``run`` (batches to batches) with :func:`give_back` at the end of each task."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


#: Rows that go to Python at a time; texts of a few kilobytes make a few megabytes, on both sides of the pipe.
ROWS_A_BATCH = 1000


def bounded_batches(spark) -> None:
    """Lower the session's Arrow batches to ``ROWS_A_BATCH`` rows, if they are larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_A_BATCH:
        spark.conf.set(key, str(ROWS_A_BATCH))
