"""Folders on whatever file system Spark sees: small text files and written-once tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session. Only a session on this machine alone may do without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "vectide-scratch")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder once and read back."""
    path = f"{scratch_root(df.sparkSession)}/vectide-{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession):
    """Deletes what this application has put in the shared folder; results that are read from there end with it."""
    remove(spark, f"{scratch_root(spark)}/vectide-{spark.sparkContext.applicationId}")


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str):
    """A new file, written beside and moved into place: it is there as a whole or not at all."""
    p, fs = _path(spark, path)
    beside, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(beside, True)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    if not fs.rename(beside, p):
        fs.delete(beside, False)
        raise OSError(f"could not write {path}")


def names_in(spark: SparkSession, path: str) -> list[str]:
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str):
    p, fs = _path(spark, path)
    fs.delete(p, True)
