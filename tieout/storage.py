"""Folders for what a query writes and reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder the cluster names; a temporary one only in local mode without such."""
    shared = spark.sparkContext._jsc.sc().getCheckpointDir()
    root = shared.get() if shared.isDefined() else spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
        root = f"file:{tempfile.mkdtemp(prefix='tieout-')}"
    return f"{root}/{name}-{uuid.uuid4().hex}"
