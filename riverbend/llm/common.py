"""What the operators share: the shared folder, checkpoints, and null-safe inputs."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.
WS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where
    that is unset, which only suits a session without remote executors, such as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = f"file://{tempfile.mkdtemp(prefix='riverbend-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    if "://" not in at:  # as Spark's default file system has it, with its scheme
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        at = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        at = at.replace("file:/", "file:///", 1) if at.startswith("file:/") else at
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there stays until the application's owner removes it."""
    return f"{shared_dir(spark).rstrip('/')}/riverbend-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that later stages survive lost executors without recomputing it.
    Spark removes the files when the frame is no longer referenced and spark.cleaner.referenceTracking.cleanCheckpoints is set.

    A checkpointed frame keeps the size estimate of its plan, and a join's estimate is the product of its sides': over the
    rounds of an iteration these numbers grow to megabytes and planning takes longer than the work. The frame returned starts
    from no estimate; AQE goes by the sizes at run time. It has no known partitioning either."""
    spark = df.sparkSession
    shared_dir(spark)
    kept = df.checkpoint(eager=True)
    fresh = spark._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False)
    return type(kept)(fresh, spark)


def lean(work: Callable) -> Callable:
    """work, from batches to batches, with its memory given back to the system when it ends: Python workers live on and
    would otherwise keep the most that any of their tasks ever held."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def text_of(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


#: Rows that Spark hands to Python at a time where rows hold whole texts.
TEXT_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Hold the session to Arrow batches of TEXT_ROWS rows, unless it asks for smaller ones: batches of texts are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, TEXT_ROWS)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """df dealt out evenly. Spark splits skewed partitions of a join only where both sides come straight from
    a shuffle for that join; a side that an aggregation has left partitioned by the key needs this first."""
    return df.repartition(shuffle_parts(df.sparkSession))
