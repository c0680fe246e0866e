"""What Python workers may hold: small batches while a task runs, and nothing much afterwards."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

from corpusloom.llm import textvec, wordbpe

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


#: Bytes of a batch between Spark and a worker, where the session doesn't set them itself.
#: Spark's own limit is some sixteen times that, and each side holds a batch more than once.
BATCH_BYTES = "4m"
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def release() -> None:
    """Let go of what workers, which outlive their tasks, would otherwise hold through later stages."""
    textvec.forget()
    wordbpe.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def chained(first: Run, then: Run) -> Run:
    """Both in one worker."""
    return lambda batches: then(first(batches))


def tidy(run: Run) -> Run:
    """run, on small batches, with its worker's memory given back at the task's end."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(_LIMIT, None) is None:
        spark.conf.set(_LIMIT, BATCH_BYTES)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole
