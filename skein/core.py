"""Tables in the shared folder, and broadcasts behind a count."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a join side is broadcast, and the bytes up to which those rows may come (by the optimizer's size of the side).
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Bytes of a row group of such a table: what a task that writes holds in its executor's heap.
ROW_GROUP = 16 << 20
#: Python workers hand large blocks back to the system when they free them, rather than keep them for the next stage.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "131072", "MALLOC_TRIM_THRESHOLD_": "131072"}


def prepare(spark: SparkSession) -> None:
    """Python workers find this package where the driver does and give memory back; Arrow batches are bounded by bytes."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    for k, v in WORKER_ENV.items():
        env.setdefault(k, v)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


@functools.cache
def _own_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="skein-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir as Spark's file systems name it in full; a local one only where that is unset (tests)."""
    top = spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark.sparkContext.applicationId)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/skein/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def plan_bytes(df: DataFrame) -> int:
    """What the optimizer takes for the size of df: of a scanned table that of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def task_count(source: DataFrame, each: int = 256 << 20) -> int:
    """How many tasks, and so files, serve for what is made of a table: one for each 256 MB of it, and at least two a core.

    Where its size isn't known (no scan, or a join's estimate beyond a petabyte) they are as many as a shuffle has.
    """
    spark, size = source.sparkSession, plan_bytes(source)
    tasks = -(-size // each) if size < 1 << 50 else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(2 * spark.sparkContext.defaultParallelism, tasks)


def written(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """df as a table in the shared folder, which ends its lineage: a lost executor costs no more than the tasks that it ran.

    tasks: at most so many files (see task_count); smaller partitions are merged, larger ones never split.
    """
    path = shared_path(df.sparkSession, name)
    (df if tasks is None else df.coalesce(tasks)).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(side: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a side has few rows, and few bytes by the size of its files or of what the optimizer expects of it. It must be cheap to count (written)."""
    return plan_bytes(side) <= BROADCAST_BYTES and side.limit(rows + 1).count() <= rows


def join_checked(df: DataFrame, side: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """A join whose side is broadcast only when it is small, and else left to Spark (sort-merge, skew split by AQE)."""
    return df.join(F.broadcast(side) if is_small(side, rows) else side, on, how)
