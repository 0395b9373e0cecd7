"""The folder that driver and executors share, for tables that a job writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only where neither is set and everything runs in one process, as in tests, is a temporary
    folder made and set. On a cluster each executor would write to its own disk, so there it is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get(KEY, None) or context.getCheckpointDir()
    if not folder:
        if context.master.split("[")[0] != "local":
            raise RuntimeError(f"set {KEY} to a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="wareflow-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/wareflow/{tag}-{uuid.uuid4().hex}"
