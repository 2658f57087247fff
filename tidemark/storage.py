"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Where a local session (tests)
    names none, a temporary one is set; elsewhere that is an error, as each executor would write to
    its own disk."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not sc.getCheckpointDir():
        if not found and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-tidemark-", dir="/tmp"))
    return (found or sc.getCheckpointDir()).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder: the lineage ends there and an executor may be lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
