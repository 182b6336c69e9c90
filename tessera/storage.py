"""Scratch tables in the folder the cluster shares (``spark.checkpoint.dir``).

A table written here cuts lineage and outlives any executor.  The folder comes
from the session; only where it is unset on a local master (tests) is one below
the local temporary folder made, on a cluster that is an error.  Scratch is deleted when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session, set to a fresh one if unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _remove(path: str) -> None:
    spark = _roots.pop(path, None)
    if spark is None:
        return
    try:
        jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone when the interpreter ends
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    _roots[path] = spark
    atexit.register(_remove, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the table read back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    _remove(getattr(df, "_scratch_path", ""))
