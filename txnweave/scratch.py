"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new path in ``spark.checkpoint.dir``; where that is unset and all runs in one process (tests), in a temporary folder."""
    global _local
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        _local = _local or "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        base = _local
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The table as written to the shared folder: its lineage is cut, and all who read it see the same rows."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
