"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session on one machine may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own for a table, below one folder for each application."""
    folder = f"{shared_folder(spark)}/quern/{spark.sparkContext.applicationId}"
    if folder not in _written:
        _written.add(folder)
        atexit.register(_leave, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage, survives lost executors, prunes columns on reading."""
    return stored(df, new_path(df.sparkSession, name), **options)


def stored(df: DataFrame, path: str, **options: str) -> DataFrame:
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task is dealt at most, about, where a job says how many there are.
SHARE = 1 << 19


def dealt(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """`df` dealt by `keys` in shares of about SHARE rows, if that takes more shares than the session's setting; else as it is.

    So a task's memory does not grow with the table under a fixed setting. rows: how many `df` has at most; None leaves it to Spark.
    """
    parts = -(-(rows or 0) // SHARE)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _leave(spark: SparkSession, folder: str) -> None:
    """At the end of the driver, delete what the application wrote; `clear` does so earlier. A driver that is killed leaves its folder."""
    if spark.sparkContext._jsc is not None:  # not stopped before
        remove(spark, folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; frames built on them can no longer be read."""
    remove(spark, f"{shared_folder(spark)}/quern/{spark.sparkContext.applicationId}")
