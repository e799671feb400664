"""Durable intermediate tables.

Lineage is cut by writing Parquet below the folder that the cluster names in
``spark.checkpoint.dir``; every executor can read it, so a lost executor costs a
re-read and never a failed stage.  Only a purely local session (tests) may lack
the setting, and then a temporary folder is used.  What was written stays until :func:`release` is called.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: list[str] = []
_WRITTEN: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors can reach."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir has to name a shared folder on a cluster")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append("file://" + tempfile.mkdtemp(prefix="lexloom-"))
    return _LOCAL_ROOT[0]


#: Bytes of rows that go to a Python worker at a time, unless the session says otherwise.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep batches of long texts small, so that Python workers do."""
    # 64 MB is what Spark has by default
    if spark.conf.get(BATCH_SETTING).rstrip("b") == str(64 << 20):
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")


def new_path(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A path below the shared folder that nothing else uses; :func:`release` passes over those to keep."""
    bound_batches(spark)
    path = f"{shared_root(spark)}/lexloom/{label}-{uuid.uuid4().hex}"
    if not keep:
        _WRITTEN.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, keep: Collection[str] = ()) -> None:
    """Delete what :func:`materialize` and others wrote below the shared folder, but for the paths to keep; call it once results are stored."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for written in [p for p in _WRITTEN if p not in keep]:
        path = jvm.org.apache.hadoop.fs.Path(written)
        path.getFileSystem(conf).delete(path, True)
        _WRITTEN.remove(written)
