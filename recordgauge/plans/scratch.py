"""Where jobs that need a written intermediate put it, and how they take it away again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's folder under the cluster's shared folder.

    The shared folder is the session's ``spark.checkpoint.dir`` or, where that is unset, what
    ``SparkContext.setCheckpointDir`` named. Only a session whose driver and executors are one
    process (``local``, ``local[n]``) may name neither; it gets a folder of its own.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{context.applicationId}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, *by: str) -> tuple[DataFrame, str]:
    """``df`` written once as Parquet and read back, with the path for ``discard``.

    ``by`` names columns whose values get directories of their own.

    Cuts the lineage in storage that outlives executors: after the loss of one, readers fetch
    the files again instead of computing them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete what a job has written and no longer needs."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
