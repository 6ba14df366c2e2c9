"""Tables that cut lineage, written to the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset and one machine runs everything, a local folder."""
    global _local
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    _local = _local or tempfile.mkdtemp(prefix="checkpoints-")
    return _local


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of any address that Spark can read."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/cellatlas-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def release(*frames: DataFrame) -> None:
    """Deletes the files behind frames made by :func:`written` once nothing reads them any more."""
    for df in frames:
        delete(df.sparkSession, df._scratch_path)
