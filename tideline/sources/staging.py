"""Staged tables: results written to the shared folder before anything relies on them.

A staged table is a Parquet copy under ``spark.checkpoint.dir`` (the private
folder of a local session where none is set), so it outlives a lost executor
and every later read sees the same rows.  Names carry a random part; two runs
never write to one place.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tideline.session import ensure_checkpoint_dir


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or ensure_checkpoint_dir(spark)).rstrip("/")


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in any store that Spark reads; nothing happens where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@dataclass
class StagedTable:
    path: str
    df: DataFrame

    def drop(self) -> None:
        """Delete the copy; call it when nothing reads ``df`` any more."""
        remove_path(self.df.sparkSession, self.path)


def stage_table(df: DataFrame, name: str) -> StagedTable:
    """Write ``df`` and return the copy; what a failed write left is removed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{name}-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
    except Exception:
        remove_path(spark, path)
        raise
    return StagedTable(path, spark.read.schema(df.schema).parquet(path))
