"""Tables and files that a job keeps for its own later steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. In a session of one process, where it is unset, a folder of our own will do."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="blockloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def own_path(spark: SparkSession, name: str | None = None) -> str:
    """A new path in the shared folder that is deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name or uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame) -> DataFrame:
    """Write a table as Parquet in the shared folder and read it back: it is computed once, and survives lost executors."""
    path = own_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
