"""What the operators of this subpackage have in common: shared storage and bounded Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import scratch_dir, written  # noqa: F401  (the operators take them from here)

#: Characters of text that one step of a Python stage handles at a time.
STEP_CHARS = 2_000_000


def drop_written(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files behind ``written`` tables that nothing needs any more."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        for file in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` characters each, at least one row."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The column as Python strings, null as the empty string."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]


def give_back() -> None:
    """Return freed memory to the system; by themselves the allocators of Arrow and C keep most of it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, with its freed memory given back at the end of each task.

    Spark keeps workers for later tasks and beside later stages that run no Python at all, which need the memory for the JVM."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
