"""Texts packed into batches, and lookups of a batch's distinct keys in tables that grow with the corpus.

A dictionary over a corpus (word counts, n-gram probabilities, encoded words) has no bound, so it is never broadcast, and
joining it to every occurrence would shuffle the corpus many times over. Instead texts are packed into batches of some
megabytes; each batch lists its distinct keys; these are joined to the dictionary; and every batch meets its own small
part of it. What is shuffled is each batch's distinct keys; the packed text lies in buckets by batch and stays there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bucketed, trim

#: Bytes of text in a batch (a longer text is a batch of its own).
BATCH = 32 << 20
PACKED = "batch long, doc_id array<long>, flag array<boolean>, size array<long>, data binary"


def pack(docs: DataFrame, flag, batch_bytes: int | None = None) -> DataFrame:
    """Pack (doc_id, text) into rows of PACKED, kept in the shared folder in buckets by batch. Null texts are empty."""

    batch_bytes = batch_bytes or BATCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        flags: list[bool] = []
        texts: list[bytes] = []
        part, count, held = TaskContext.get().partitionId(), 0, 0

        def out() -> pa.RecordBatch:
            sizes = [len(t) for t in texts]
            squeeze = zstandard.ZstdCompressor(6).compressobj()
            data = [squeeze.compress(t) for t in texts]
            texts.clear()
            cols = [[(part << 32) + count], [ids], [flags], [sizes], [b"".join([*data, squeeze.flush()])]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["batch", "doc_id", "flag", "size", "data"])

        for b in batches:
            for i, f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = t.as_buffer().to_pybytes() if t.is_valid else b""
                if texts and held + len(text) > batch_bytes:
                    yield out()
                    ids, flags, texts, held, count = [], [], [], 0, count + 1
                ids.append(i)
                flags.append(bool(f))
                texts.append(text)
                held += len(text)
            b = t = text = None  # the batch that came in goes before the one that goes out is made
        if texts:
            yield out()
        trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), flag.alias("flag"), F.col("text").cast("binary").alias("text"))
    return bucketed(rows.mapInArrow(run, PACKED), "batch")


def unpack(row: pa.RecordBatch | pa.Table, k: int) -> tuple[int, list[int | None], np.ndarray, list[bytes]]:
    """batch, doc_ids, flags and texts, A-Z lower-cased, of one packed row."""
    cell = lambda name: row.column(row.schema.get_field_index(name))[k]
    size = np.array(cell("size").as_py(), np.int64)
    data = zstandard.ZstdDecompressor().decompressobj().decompress(cell("data").as_buffer()).translate(LOWER) if size.sum() else b""
    ends = np.cumsum(size).tolist()
    texts = [data[e - n : e] for e, n in zip(ends, size.tolist())]
    return cell("batch").as_py(), cell("doc_id").as_py(), np.array(cell("flag").as_py(), bool), texts
