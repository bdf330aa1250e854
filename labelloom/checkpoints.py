"""Where iterative operators cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A folder for intermediate tables that all executors share: spark.checkpoint.dir, or, where that is unset and
    the session is local, a new local one, which is then set for this session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="labelloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def ready(spark: SparkSession) -> None:
    """Sets a checkpoint folder where the session names none: spark.checkpoint.dir, or a local one in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(scratch(spark))
