"""Tables that are written once and read more than once: they survive lost executors, and cut the lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``; a folder of our own serves a local session alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = getattr(checkpoint_root, "own", None)
        if root is None:
            os.makedirs("/tmp/checkpoints", exist_ok=True)
            root = checkpoint_root.own = "file://" + tempfile.mkdtemp(prefix="rulesift-", dir="/tmp/checkpoints")
    return root.rstrip("/")


_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, which goes with the session if ``drop`` doesn't take it before."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    files, at = _files(spark, path)
    files.deleteOnExit(at)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``written`` has returned and that nothing reads any more."""
    for t in tables:
        if path := _WRITTEN.pop(t, None):
            files, at = _files(t.sparkSession, path)
            files.delete(at, True)
