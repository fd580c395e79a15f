"""Intermediate tables that survive lost executors.

Lineage is cut by writing Parquet to the folder that the cluster names in
``spark.checkpoint.dir``, which driver and executors share.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set: a fresh local one if all runs on one machine, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lumigrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a reader of the copy."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession | None = None) -> None:
    """Delete the intermediate tables written so far; results that still read them become invalid."""
    keep = []
    for session, path in _written:
        if spark is not None and session is not spark:
            keep.append((session, path))
            continue
        try:
            jvm = session.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may have ended; then the cluster clears its own folder
            pass
    _written[:] = keep


atexit.register(release)
