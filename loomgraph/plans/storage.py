"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}
_where: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Only a local session without the setting gets a temporary folder."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _made.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="loomgraph-"))


def _file(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file(spark, path)
    return fs.exists(where)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder."""
    fs, where = _file(spark, path)
    return [found.getPath().getName() for found in fs.listStatus(where)]


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _file(spark, path)
    fs.delete(where, True)


def delete_at_exit(spark: SparkSession, path: str) -> str:
    """The JVM deletes the folder when it ends."""
    fs, where = _file(spark, path)
    fs.deleteOnExit(where)
    return path


def stash(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again, so that a lost
    executor costs a read and not the work before.  ``drop_stash`` deletes it,
    or else the JVM at its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(delete_at_exit(spark, path))
    _where[out] = path
    return out


def drop_stash(*tables: DataFrame) -> None:
    """Deletes stashed tables that nothing reads any more; others are left alone."""
    for table in tables:
        if path := _where.pop(table, None):
            delete(table.sparkSession, path)
