"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def checkpointed(spark: SparkSession) -> None:
    """Makes ``checkpoint()`` usable: the folder of spark.checkpoint.dir, or a temporary one in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="maskforge-")
    context.setCheckpointDir(folder)
