"""Places for what steps write between them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names, which all executors share.

    Only a local session may leave that unset; it then gets a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def partition_column(spark: SparkSession, path: str) -> str | None:
    """The column by which a table is kept in folders, null if it has none yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*=*")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found[0].getPath().getName().partition("=")[0] if found else None
