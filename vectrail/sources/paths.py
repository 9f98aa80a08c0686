"""Work folders that all executors see."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession


@functools.cache
def _own(application: str) -> str:
    return tempfile.mkdtemp(prefix="vectrail-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where a local master names none, one folder of this machine for the application."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own(spark.sparkContext.applicationId)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
