"""Steps that several later ones read, written once as Parquet in a folder that all executors share."""

from __future__ import annotations

import atexit
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

_known: set[str] = set()


def folder(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir; under /tmp only where that is unset and the master is this
    machine. It goes when the driver ends."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "/tmp/tidemark-steps"
    path = f"{top.rstrip('/')}/tidemark-steps/{spark.sparkContext.applicationId}"
    if path not in _known:
        _known.add(path)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the context may be gone
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame) -> DataFrame:
    """df, run once and read from its files."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
