"""A folder for files that later steps of the same session read again, shared by the whole cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under ``spark.checkpoint.dir``, or under a local folder where that is unset and everything runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        root = _LOCAL[app]
    return f"{root}/scratch/{label}-{uuid.uuid4().hex[:12]}"
