"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which an execution's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCK, _WRITES, _KEPT = threading.Lock(), [], [None]


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).

    Where the setting is absent, a session in one process (``local``) gets a temporary folder; on a cluster that would lie on
    each machine's own disk, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="scopegrain-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there and survives lost executors.

    The shuffle files of the write go at its end; the table's files at ``release``, else when the JVM ends. The cleaning is a
    setting of the session, put back after the last of the writes that run at once; where it stands on, it stays on.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _LOCK:
        if not _WRITES:
            _KEPT[:] = [spark.conf.get(CLEANUP, None)]
            spark.conf.set(CLEANUP, "true")
        _WRITES.append(path)
    try:
        df.write.parquet(path)
    finally:
        with _LOCK:
            _WRITES.remove(path)
            if not _WRITES:
                spark.conf.unset(CLEANUP) if _KEPT[0] is None else spark.conf.set(CLEANUP, _KEPT[0])
    where, fs = file_at(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._scopegrain_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete the files of a table that ``materialise`` returned; others are left alone."""
    path = getattr(df, "_scopegrain_path", None)
    if path:
        where, fs = file_at(df.sparkSession, path)
        fs.delete(where, True)


def file_at(spark: SparkSession, path: str):  # noqa: ANN201
    """A path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())
