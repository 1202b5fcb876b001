"""Scratch space that the driver and all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``; a folder of our own is set only where that setting
is missing (local tests).  Intermediate tables written here cut the lineage and survive the loss of an executor.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI; where the session names none, a temporary one if all runs on this machine, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = found.get() if found.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillmark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/quillmark/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back (same schema, lineage cut)."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(*tables: DataFrame) -> None:
    """Remove materialised tables that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "scratch_path", None):
            _delete(table.sparkSession, path)
            _made[:] = [m for m in _made if m[1] != path]


def tidy(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of jobs that ended: it does so once the objects that stand for them are collected,
    and a driver with little to do may not come to that while the disks fill up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may already be gone
            return
