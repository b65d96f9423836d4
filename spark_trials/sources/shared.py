"""A folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in ``spark.checkpoint.dir``. A cluster must name that; a session that is one machine alone
    (``local``), as in tests, gets one of its own where none is named."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="spark-shared-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
