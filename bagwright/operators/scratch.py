"""Cutting lineage: reliable checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def write_out(df: DataFrame) -> DataFrame:
    """A checkpoint of df in spark.checkpoint.dir; where that is unset and Spark runs on one machine, in a folder of our own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="bagwright-"))
    return df.checkpoint()
