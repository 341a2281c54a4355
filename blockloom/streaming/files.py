"""Streams: new files as blocks, call metrics in windows, and a circuit breaker per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.breaker import CLOSED, walk
from ..plans.convert import convert_files, convert_texts
from ..sources import event_log
from ..sources.files import BINARY, MOST_BYTES, described


def text_stream(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """New text files of a folder, one row each: path, text."""
    reader = spark.readStream.format("text").option("wholetext", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def stream_convert(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str, **options):
    """Start a query that turns every micro-batch of new files into blocks and hands them to sink(blocks, batch id)."""

    def each(batch: DataFrame, n: int) -> None:
        docs = batch.withColumn("doc_id", F.xxhash64("path"))
        sink(convert_texts(docs, **options).join(docs.select("doc_id", "path"), "doc_id"), n)

    return text_stream(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_files(spark: SparkSession, folder: str, path: str, checkpoint: str, glob: str | None = None, most_bytes: int = MOST_BYTES, **options):
    """Start a query that converts new files of all types: blocks and documents go to two logs below path (see event_log.read).

    Each micro-batch is added to a log under its number, whole and once: a batch that is run again after a restart, with its
    checkpoint or without one that was lost, adds nothing twice, and one that was killed between the logs is completed. A
    file that is too large is a document with an error and is not read. options: those of plans.convert.convert_files.
    """
    reader = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)

    def each(batch: DataFrame, n: int) -> None:
        blocks, documents = convert_files(batch, **options)
        for rows, name in ((blocks, "blocks"), (documents, "documents")):
            event_log.append(rows, f"{path}/{name}", f"{n:020d}")

    # described before the batches are cut, as filters reach the scan only there
    return described(reader.load(folder), most_bytes).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed(spark: SparkSession, path: str, name: str = "blocks") -> DataFrame:
    """What stream_files has written so far: blocks by (doc_id, pos), or documents by doc_id, each from the first batch that has it."""
    return event_log.read(spark, f"{path}/{name}", ("doc_id",))


def windowed_metrics(events: DataFrame, length: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Calls, failures and latency per driver and window of a stream (ts, driver, ok, latency_ms)."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", length), "driver")
    return out.agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failures"), F.sum("latency_ms").alias("total_latency_ms"))


def breaker_stream(calls: DataFrame, failures: int = 3, window: float = 10.0, recovery: float = 30.0) -> DataFrame:
    """(key, id, open_after) of a stream of calls (key, id, ts seconds, ok), with each key's streak kept as state."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        """A micro-batch's calls of one key are sorted by number and time only: 25 bytes a call."""
        begun = state.get if state.exists else CLOSED
        rows = pd.concat([p[["ts", "id", "ok"]] for p in parts]).sort_values(["ts", "id"])
        states = walk(begun, rows["ts"], rows["ok"], failures=failures, window=window, recovery=recovery)
        state.update(states[-1])
        yield pd.DataFrame({"key": key[0], "id": rows["id"], "open_after": [opened is not None for _, _, opened in states]})

    return calls.groupBy("key").applyInPandasWithState(run, "key string, id bigint, open_after boolean", "first double, n int, opened double", "append", "NoTimeout")
