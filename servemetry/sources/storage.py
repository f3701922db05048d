"""Shared folders for lineage cuts and written tables."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only a session of one local process that names none gets a temporary one, the same throughout.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{tempfile.gettempdir()}/servemetry-{spark.sparkContext.applicationId}"


def pin(df: DataFrame) -> DataFrame:
    """Fix the rows of `df` in reliable storage, so every later read agrees."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Ask the driver to collect garbage, on which Spark removes shuffle files that no DataFrame refers to.

    Worth it between large steps, after the result of one is pinned: otherwise its shuffles stay on the
    executors' disks until the driver happens to collect.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
