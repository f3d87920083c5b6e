"""Normalised views and label tables written once and read by every query, as Parquet with pruned columns."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[tuple[str, str, str], str] = {}


def folder(spark: SparkSession) -> str | None:
    """A folder that the driver and all executors share: the checkpoint folder, or a local one for a local session; else none."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and spark.sparkContext.master.startswith("local"):
        shared = os.path.join(tempfile.gettempdir(), "kindred-views")
    return shared


def materialised(spark: SparkSession, source: str, name: str, make) -> DataFrame:
    """``make()`` as a table that is written at its first use in a session and then read. ``source`` names what it is made of.

    Without a shared folder it is made anew each time.
    """
    at = folder(spark)
    if at is None:
        return make()
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _WRITTEN:
        path = f"{at}/views-{uuid.uuid4().hex}/{name}"
        make().write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows written to the shared folder, without lineage; the shuffle files of their job are deleted at once.

    Without a shared folder nothing is written.
    """
    spark = df.sparkSession
    at, context = folder(spark), spark.sparkContext
    if at is None:
        return df
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(at)
    own = df.select("*")
    written = own.checkpoint(eager=True)
    plan = own._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        for shuffle in plan.context().shuffleIds().keySet().toArray():
            context._jsc.sc().shuffleDriverComponents().removeShuffle(shuffle, True)
    return written
