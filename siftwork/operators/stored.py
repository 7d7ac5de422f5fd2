"""Lineage cuts that outlive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Folders that this driver wrote and has not dropped.
_written: list[str] = []


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="siftwork-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of its own only for a local master, where one machine is all there is."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or _own_folder()).rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/siftwork/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> int:
    """Deletes all tables that ``stored`` wrote so far, once results that read them are written; returns their number."""
    n, conf = len(_written), spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
