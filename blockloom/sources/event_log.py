"""An event log that survives retries: a batch is there once and whole, or not at all.

Each batch has a folder of its own, and is committed by the marker that Spark leaves when all its files are in place. A batch
that is committed is not written again; what a killed job left of one is overwritten when it is run again, and is not read
before. An event that a later batch repeats (the same document, prompt and kind) is read once, from the first batch by name.
"""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MARKER = "_SUCCESS"
KEY = ("doc_id", "prompt", "event")


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _folder(path: str, batch: str) -> str:
    return f"{path}/batch={quote(batch, safe='')}"


def committed(spark: SparkSession, path: str) -> list[str]:
    """Names of the batches that are in the log, in order."""
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
    return sorted(unquote(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and fs.exists(_fs(spark, f"{path}/{n}/{MARKER}")[1]))


def append(events: DataFrame, path: str, batch: str) -> bool:
    """Add a batch of events; False if it is in the log already, then nothing is done. An empty batch is committed, too."""
    spark = events.sparkSession
    fs, marker = _fs(spark, f"{_folder(path, batch)}/{MARKER}")
    if fs.exists(marker):
        return False
    events.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(_folder(path, batch))
    return True


def uncommit(spark: SparkSession, path: str, batch: str) -> None:
    """Take back a batch's commit: it is no longer read, and can be written again."""
    fs, marker = _fs(spark, f"{_folder(path, batch)}/{MARKER}")
    fs.delete(marker, False)


def read(spark: SparkSession, path: str, key: Iterable[str] = KEY) -> DataFrame:
    """All events of committed batches with `batch`. Of events that agree in the key across batches those of the first batch stay.

    Events of one batch that agree in it are all kept: a batch is as it was written. Keys are compared with nulls equal.
    """
    names = committed(spark, path)
    if not names:
        raise ValueError(f"no committed batch in {path}")
    parts = [spark.read.parquet(_folder(path, b)).withColumn("batch", F.lit(b)) for b in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    key = [k for k in key if k in out.columns]
    if not key or len(names) == 1:
        return out
    # a key's events are some retries of one request
    return out.withColumn("_first", F.min("batch").over(Window.partitionBy(*key))).where(F.col("batch") == F.col("_first")).drop("_first")


def sink(path: str, *also) -> object:
    """A function for foreachBatch that adds each micro-batch under its number; a batch that is run again after a restart adds nothing."""

    def each(batch: DataFrame, number: int) -> None:
        if append(batch, path, f"{number:020d}"):
            for f in also:
                f(batch, number)

    return each
