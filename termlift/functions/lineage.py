"""Cutting a plan's lineage where a result is read many times or made in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether the end of an execution removes its shuffle files.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which all executors share; where that is unset (tests on one
    machine), in a new one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = context._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="termlift-")
        context.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, which survives lost executors, is pruned where it is read and has a
    size that the planner knows.

    What was shuffled for it is removed as soon as it is written, since Spark otherwise keeps that until the driver's garbage
    is collected: a query of many cuts would hold on disk what all of them shuffled."""
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        df.select("*").write.parquet(path)  # a plan of its own, made with that setting
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)
