"""Intermediate tables that more than one job reads."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor reaches, as the cluster names it in spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    # Only a session that is one process may do without; local-cluster has executors of its own.
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="gristmill-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _session_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/gristmill-{spark.sparkContext.applicationId}"


def keep(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder once and read it from there.

    The written copy outlives lost executors and ends the lineage. Its rows stay the same for
    every job that reads it, and its size can be measured.
    """
    spark = df.sparkSession
    path = f"{_session_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_kept_tables(spark: SparkSession) -> None:
    """Delete the tables this session has kept. Results that read them can no longer be used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_session_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
