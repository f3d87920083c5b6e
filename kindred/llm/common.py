"""What the operators of this subpackage share: bounded batches, checkpoints, table access."""

from __future__ import annotations

import gc
import os
import tempfile
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bytes of Arrow data that a Python step holds at once (one row may be longer).
CHUNK_BYTES = 8 << 20
#: White space of the word definition ``[^\x20\x09-\x0D]+`` as a Java and Python class.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes, so that long texts do not add up."""
    for batch in batches:
        stack = [batch]
        while stack:
            part = stack.pop()
            if part.num_rows > 1 and part.nbytes > limit:
                half = part.num_rows // 2
                stack += [part.slice(half), part.slice(0, half)]
            elif part.num_rows:
                yield part


def strings(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def widened(schema: StructType, more: str) -> StructType:
    """The fields of ``schema`` and those of the DDL string ``more``."""
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or the folder given to its context; a local folder only for a local session without either."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "kindred-checkpoints")


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store its path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows written to the shared checkpoint folder; lineage ends here and no executor owns them.

    The shuffle files of the job are deleted at once. They are those of a plan of its own, which nothing else runs.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    own = df.select("*")
    written = own.checkpoint(eager=True)
    plan = own._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        parts = context._jsc.sc().shuffleDriverComponents()
        for shuffle in plan.context().shuffleIds().keySet().toArray():
            parts.removeShuffle(shuffle, True)
    return written


def discard(*frames: DataFrame) -> None:
    """Deletes the files of checkpointed rows that nothing reads any more."""
    for df in frames:
        at = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if at.isDefined():
            deleted(df.sparkSession, at.get())


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished jobs now; else they stay until the driver's next collection.

    Goes on while their number falls: the first collections only free what holds the references.
    """
    context = spark.sparkContext
    statuses = context._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    before, still = statuses.size(), 0
    for _ in range(12):
        gc.collect()
        context._jvm.System.gc()
        time.sleep(0.25)
        now = statuses.size()
        still = still + 1 if now >= before else 0
        before = now
        if still == 2 or not now:
            break
