"""Where intermediate tables go: the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder: spark.checkpoint.dir. Where it is unset, a folder of our own on a local
    master; on a cluster an error, as each executor would write to its own disk."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-holdfast-"))
    return context.getCheckpointDir().rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends there, and any
    executor can be lost later. The reread table carries file sizes, so joins are planned on facts."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
