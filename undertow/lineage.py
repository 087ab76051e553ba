"""Ending a plan's lineage with files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where the session names none and is one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = getattr(spark, "_undertow_shared", None)
    if own is None:
        own = spark._undertow_shared = "file://" + tempfile.mkdtemp(prefix="undertow-")
    return own


def delete(spark: SparkSession, path: str) -> None:
    """Deletes ``path`` where Spark sees it; a session that has ended leaves its scratch files to the folder's owner."""
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # at exit the gateway may be gone
        pass


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written once as Parquet (to ``path``, or to scratch files that go with the driver) and read back.

    Later jobs, and tasks rerun after an executor is lost, start from these files.
    """
    spark = df.sparkSession
    if path is None:
        path = f"{shared_dir(spark)}/undertow/{uuid.uuid4().hex}"
        atexit.register(delete, spark, path)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._undertow_path = path
    return out


def forget(df: DataFrame | None) -> None:
    """Deletes the files of a ``cut`` that nothing reads any more."""
    path = getattr(df, "_undertow_path", None)
    if path:
        delete(df.sparkSession, path)
