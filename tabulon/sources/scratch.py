"""The folder for written tables that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A local session without one gets a temporary folder; a cluster, an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        root = "file://" + tempfile.mkdtemp(prefix="tabulon-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")
