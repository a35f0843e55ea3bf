"""What the operators of this subpackage share: the shared work folder, bounded Arrow batches, memory that is given back, and checked broadcasts."""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skein.core import ROW_GROUP, is_small, join_checked, prepare, task_count, written
from skein.core import shared_path as work_path
from skein.operators.ordering import fresh

__all__ = ["bounded_batches", "foreign_kept", "is_small", "join_checked", "open_fs", "released", "task_count", "task_tag", "tokenizer_path", "work_path", "written"]

#: Bytes of an Arrow batch handed to Python; a single longer row makes a batch of its own. Buffers of this size come from the JVM's pools and stay few.
ARROW_BYTES = 1 << 20
#: Rows that a scan decodes together: their texts are one array in the executor's heap.
SCAN_ROWS = 512

Batches = Iterator[pa.RecordBatch]


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes, so that long texts don't add up in a Python worker; scans and row groups of files likewise, so that they don't in the executor's JVM."""
    prepare(spark)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(SCAN_ROWS))
    spark.conf.set("parquet.block.size", str(ROW_GROUP))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


@functools.cache
def _trim():
    import ctypes

    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda pad: 0


def released(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run for mapInArrow; what a task has freed goes back to the system when it ends, as its worker may wait for a later stage."""

    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return task


def foreign_kept(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose own columns begin with two underscores, for tables that have such columns as well: theirs have other names meanwhile."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **more) -> DataFrame:
        given = {a for a in (*args, *more.values()) if isinstance(a, str)}
        odd = [c for c in docs.columns if c.startswith("__") and c not in given]
        if not odd:
            return operator(docs, *args, **more)
        new = dict(zip(odd, fresh(docs.columns, *["foreign"] * len(odd)), strict=True))
        named = lambda a: [new.get(x, x) for x in a] if isinstance(a, list) and all(isinstance(x, str) for x in a) else a
        out = operator(docs.withColumnsRenamed(new), *map(named, args), **{k: named(a) for k, a in more.items()})
        return out.withColumnsRenamed({v: k for k, v in new.items()})

    return run


def open_fs(uri: str):
    """(pyarrow file system, path) of a path that Spark's file systems have named in full."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        raise ValueError(f"{uri} names no file system; a path of the shared folder does")
    return fs.FileSystem.from_uri(uri)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def task_tag() -> str:
    from pyspark import TaskContext

    t = TaskContext.get()
    return f"{t.partitionId():08d}-{t.attemptNumber()}-{os.getpid()}-{uuid.uuid4().hex[:8]}"
