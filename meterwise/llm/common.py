"""Helpers shared by the operators: staged tables, guarded columns, slices of Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise.session import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def staged(frame: DataFrame, name: str) -> DataFrame:
    """Writes the frame as a table in the shared folder and reads it back; a lost executor loses nothing of it."""
    spark = frame.sparkSession
    path = scratch(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def discard(frame: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    spark = frame.sparkSession
    jvm = spark.sparkContext._jvm
    folders = {file.rsplit("/", 1)[0] for file in frame.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Gives freed memory back to the system: Spark keeps Python workers for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(function: Callable) -> Callable:
    """A function over Arrow batches that gives freed memory back when its task ends; a worker that waits for the next
    stage then holds little beside its modules."""

    @functools.wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator:
        try:
            yield from function(batches)
        finally:
            release()

    return run


def free_names(frame: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it differ from all columns of the frame."""
    taken = {c.lower() for c in frame.columns}
    made = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        made.append(name)
    return made


def utf8(column: Column) -> Column:
    """The text as bytes; null counts as empty."""
    return F.encode(F.coalesce(column.cast("string"), F.lit("")), "UTF-8")


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column, and where each row starts and ends; null rows are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, edges, data = column.buffers()
    edges = np.frombuffer(edges, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[edges[0] : edges[-1]], edges - edges[0]


def row_slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose text is about ``limit`` bytes together, one row at least. Numpy work on a slice needs
    some tens of times its bytes, so memory does not depend on how many rows Arrow puts into a batch."""
    if batch.num_rows == 0:
        return
    sizes = np.diff(byte_view(batch.column(batch.schema.get_field_index(column)))[1])
    begin, held = 0, 0
    for row, size in enumerate(sizes):
        if row > begin and held + size > limit:
            yield batch.slice(begin, row - begin)
            begin, held = row, 0
        held += size
    yield batch.slice(begin)
