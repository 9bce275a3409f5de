"""Memory of Python workers, which serve many tasks one after the other."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch that are turned into Python objects at a time.
ROWS, BYTES = 1_000, 8_000_000
ARROW_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand Arrow batches of at most 16 MB to Python; for programs, not for operators, to call."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(size).rstrip("b")) > ARROW_BYTES:
        spark.conf.set(size, f"{ARROW_BYTES}b")


def _give_back() -> None:
    """Return freed memory to the system; without it every worker keeps the peak of its largest task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded size, but for single long rows."""
    for batch in batches:
        step = max(1, min(ROWS, batch.num_rows * BYTES // max(batch.nbytes, 1)))
        for s in range(0, batch.num_rows, step):
            yield batch.slice(s, step)


def lean(run: Callable) -> Callable:
    """A function over Arrow batches that gets bounded batches and gives its memory back at the end."""

    @wraps(run)
    def wrapped(batches):
        yield from run(slices(batches))
        _give_back()

    return wrapped
