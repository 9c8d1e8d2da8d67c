"""Folders for tables and checkpoints that jobs write on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder named by spark.checkpoint.dir; a local one only under a local master."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
