"""Tables written down once in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_paths: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """A folder that nothing has used, in spark.checkpoint.dir; where that is unset and all runs on one machine, in a temporary one. It
    is removed when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{(base or tempfile.gettempdir()).rstrip('/')}/skein-{os.getpid()}-{uuid.uuid4().hex}"
    _paths.append((spark, path))
    return path


def saved(df: DataFrame) -> DataFrame:
    """df, written and read again: its lineage ends, nothing is computed twice, and Spark plans joins by the size that it has."""
    path = folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _remove() -> None:
    for spark, path in _paths:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended already
            return
