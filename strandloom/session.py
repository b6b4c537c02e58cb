"""What operators need from the session: tables, and the folder all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PATHS: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a test-data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a session whose master is ``local`` (tests, the benchmark) gets
    a temporary folder; on a cluster, whose executors could not read it, this is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-strandloom-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage at a place where several later steps read the same costly
    rows. The files survive the loss of executors; ``clear_written`` deletes them.
    """
    path = f"{shared_dir(df.sparkSession)}/strandloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _PATHS.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_written(spark: SparkSession) -> int:
    """Deletes what ``written`` has left, and returns the number of tables deleted; results not yet computed from them fail afterwards."""
    n = 0
    while _PATHS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
