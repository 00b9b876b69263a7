"""Written intermediate tables in the folder that all executors share.

Cutting lineage with a written table survives lost executors: what was written
is read again, nothing is recomputed from a half-lost cache.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..shared import shared_dir


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/spanloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.spanloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what :func:`written` wrote for ``df``."""
    remove(df.sparkSession, df.spanloom_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path on any file system that Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
