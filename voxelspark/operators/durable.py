"""Intermediate results that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Only a local master may run without that setting; it then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-voxelspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/voxelspark-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Writes df below spark.checkpoint.dir and reads it back: the lineage is cut, and a lost executor loses nothing."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def forget(*done: DataFrame | None) -> None:
    """Deletes the files of durable results that nothing reads any more."""
    for df in done:
        if path := getattr(df, "durable_path", None):
            jvm = df.sparkSession.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
