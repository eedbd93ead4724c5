"""Staged tables: intermediate results that several outputs read, written once to the folder all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder in spark.checkpoint.dir, removed when the driver ends.

    Where the setting is unset a temporary folder stands in, in local mode only: on a cluster it would not be shared.
    """
    sc = spark.sparkContext
    place = getattr(sc, "_paperloom_stage", None)
    if place is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="paperloom-stage-")
        place = sc._paperloom_stage = f"{base.rstrip('/')}/paperloom-{sc.applicationId}"
        atexit.register(removed, spark, place)
    return place


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder; one that is gone, or a session that has ended, is no error."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001
        pass


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` and read it back: it is computed once, its plan is a scan, and no executor's loss undoes it."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
