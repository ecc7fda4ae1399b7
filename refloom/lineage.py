"""Cutting the lineage of a result that several later steps use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame, release: bool = False) -> DataFrame:
    """The rows, written as a table to the folder that spark.checkpoint.dir names, from which each later step reads the columns that it
    uses. A local session without one gets a folder of its own; a cluster without one is refused, since executors would not see
    each other's files.

    release: collect the driver's garbage after. Shuffle files stay until the driver finds that nothing refers to them, which one with
    free memory puts off; a query of many steps would keep those of all its steps, and its heap would
    grow to the limit. The events of what was written last may still hold it, so its files go at the next cut at the latest."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="refloom-checkpoint-"))
    path = f"{context.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if release:
        context._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)
