"""Deterministic block embeddings and exact vector search."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

META, KEYS = 32, ("label", "key", "value", "title")


def unit(v: Column) -> Column:
    """A vector divided by its length; zero vectors stay. The length is bound as a variable, or each element would sum it anew."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(F.array(norm), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x)))[0]


def _draws(seed: int, key: str, n: int, half: float) -> list[float]:
    rng = random.Random(seed ^ int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "big"))
    return [rng.uniform(-half, half) for _ in range(n)]


def _unit(v: np.ndarray) -> np.ndarray:
    n = math.sqrt(float((v * v).sum()))
    return v / n if n > 0 else v


def vector(text: str, attrs: dict, page: int | None, box: tuple | None, dim: int, seed: int) -> np.ndarray:
    """Text draws, whose last 32 places are mixed 0.7 : 0.3 with draws of the attributes and the layout."""
    text = text.strip()
    out = _unit(np.array(_draws(seed, text, dim, 1.0))) if text else np.zeros(dim)
    meta = [x for k in KEYS if attrs.get(k) for x in _draws(seed, f"{k}:{attrs[k]}", 4, 0.5)]
    if box is None:
        meta += [0.0, 0.0, 0.0, 0.0, float(page or 0)]
    else:
        w, h = max(1.0, box[2] - box[0]), max(1.0, box[3] - box[1])
        meta += [box[0], box[1], w, h, math.sqrt(w * h), float(page or 0)]
    tail = _unit(np.array((meta + [0.0] * META)[:META]))
    out[-META:] = 0.7 * out[-META:] + 0.3 * tail
    return _unit(out)


def embed(blocks: DataFrame, dim: int = 256, seed: int = 42) -> DataFrame:
    """Add embedding to blocks with text, attrs, page and bbox. The generator is Python's, so rows go through Arrow batches."""
    if dim < META:
        raise ValueError(f"at least {META} dimensions")
    corners = [F.col(f"bbox.{k}") for k in ("x0", "y0", "x1", "y1")]

    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for text, attrs, page, *box in parts:
            rows = zip(text, attrs, page, *box)
            yield pd.Series([vector(t or "", dict(a) if a is not None else {}, None if pd.isna(p) else int(p), None if pd.isna(b[0]) else b, dim, seed) for t, a, p, *b in rows])

    return blocks.withColumn("embedding", F.pandas_udf(run, "array<double>")("text", "attrs", "page", *corners))


#: Vectors multiplied at a time; rows of a shard and queries of a block beyond one broadcast; lists merged at a time, and first.
TILE, SHARD, BLOCK, FAN_IN, LISTS = 2048, 32_768, 4096, 16, 256
#: Largest table of queries, in bytes of its numbers, that is sent to all tasks.
MOST_BYTES = 64 << 20
TOP = "query_id bigint, part bigint, top array<struct<loss:double,other:bigint>>"


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), dim) if len(flat) else np.zeros((0, dim))


class Best:
    """The k best (score, id) of each query so far; a larger id wins a tie. Scores count to 12 places."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.found = [(np.empty(0), np.empty(0, np.int64))] * len(ids)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for at in range(0, len(ids), TILE):
            names = ids[at : at + TILE]
            scores = np.round(self.queries @ vectors[at : at + TILE].T, 12)
            floor = np.partition(scores, -self.k, axis=1)[:, -self.k] if len(names) > self.k else np.full(len(scores), -np.inf)
            for q, (row, least) in enumerate(zip(scores, floor)):
                good = np.flatnonzero(row >= least)
                s, i = np.concatenate((self.found[q][0], row[good])), np.concatenate((self.found[q][1], names[good]))
                order = np.lexsort((-i, -s))[: self.k]
                self.found[q] = s[order], i[order]

    def rows(self, part: int) -> pa.RecordBatch:
        tops = [[{"loss": -x, "other": -y} for x, y in zip(s.tolist(), i.tolist())] for s, i in self.found]
        kind = pa.list_(pa.struct([("loss", pa.float64()), ("other", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(self.ids, pa.int64()), pa.array(np.full(len(self.ids), part, np.int64)), pa.array(tops, kind)], names=["query_id", "part", "top"])


def search(index: DataFrame, queries: DataFrame, k: int = 5, vec: str = "embedding", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(query_id, rank, id, score): the k rows of index (id, vec) with the largest cosine per row of queries (query_id, vec).

    A query meets the rows of its own length; queries of several lengths are searched length by length, and one that no row
    has the length of gives no rows. Ties go to the larger id. Products are made tile by tile and only k rows per query leave
    a task. Queries of up to `most_bytes` are sent to all tasks, after a count, and the index stays where it is. More are
    dealt over a grid of shards of the index and blocks of queries, each pair of which meets in one task. Lists are merged in
    a tree.
    """
    q = queries.select(F.col("query_id").cast("bigint").alias("query_id"), unit(F.col(vec).cast("array<double>")).alias("v")).where("query_id is not null and v is not null")
    rows = index.select(F.col("id").cast("bigint").alias("id"), unit(F.col(vec).cast("array<double>")).alias("v")).where("id is not null and v is not null")
    out = None
    for dim, n in q.groupBy(F.size("v")).count().collect() or [(0, 0)]:  # a row per length
        found = _search(q, rows, k, dim, n, most_bytes)
        out = found if out is None else out.unionByName(found)
    return out


def _search(q: DataFrame, rows: DataFrame, k: int, dim: int, n: int, most_bytes: int) -> DataFrame:
    """search() for the n queries of length dim."""
    fits = F.size("v") == dim
    if n * dim * 8 <= most_bytes:
        table = q.where(fits).toArrow()
        sent = q.sparkSession.sparkContext.broadcast((table["query_id"].to_numpy(), matrix(table["v"], dim)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(*sent.value, k)
            for b in batches:
                best.add(b.column(0).to_numpy(), matrix(b.column(1), dim))
            yield best.rows(TaskContext.get().partitionId() % LISTS)

        lists, parts = rows.where(fits).mapInArrow(run, TOP), LISTS
    else:
        blocks, shards = -(-n // BLOCK), max(1, -(-rows.count() // SHARD))
        own = rows.where(fits).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        asked = q.where(fits).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

        def cell(key: tuple, some: pa.Table, ask: pa.Table) -> pa.Table:
            best = Best(ask["query_id"].to_numpy(), matrix(ask["v"], dim), k)
            best.add(some["id"].to_numpy(), matrix(some["v"], dim))
            return pa.Table.from_batches([best.rows(key[0].as_py())])

        lists = own.select(F.col("shard").cast("bigint").alias("shard"), F.col("block").cast("bigint").alias("block"), "id", "v").groupBy("shard", "block").cogroup(asked.select(F.col("shard").cast("bigint").alias("to_shard"), F.col("block").cast("bigint").alias("to_block"), "query_id", "v").groupBy("to_shard", "to_block")).applyInArrow(cell, TOP)
        parts = shards
    return ranked(merged(lists, parts, k))


def merged(lists: DataFrame, parts: int, k: int) -> DataFrame:
    """One list per query out of lists (query_id, part, top) with parts below a number, merged in a tree."""
    while True:
        parts = -(-parts // FAN_IN)
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("query_id", "part").agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        if parts <= 1:
            return lists


def ranked(lists: DataFrame) -> DataFrame:
    """(query_id, rank, id, score) of one list per query."""
    out = lists.select("query_id", F.posexplode("top").alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), (-F.col("hit.other")).alias("id"), (-F.col("hit.loss")).alias("score"))


def add(index: DataFrame | None, entries: DataFrame, dim: int | None = None, vec: str = "embedding") -> DataFrame:
    """index with entries (id, vec, metadata) added, vectors at norm 1. Entries of another length than `dim`, or than the
    index's first row, are refused."""
    if dim is None and index is not None:
        first = index.select(F.size(vec)).first()
        dim = first[0] if first else None
    if dim is not None and not entries.where((F.size(vec) != dim) | F.col(vec).isNull()).isEmpty():
        raise ValueError(f"vectors must have {dim} dimensions")
    own = F.col("metadata") if "metadata" in entries.columns else F.create_map().cast("map<string,string>")
    new = entries.select("id", unit(F.col(vec).cast("array<double>")).alias(vec), own.alias("metadata"))
    return new if index is None else index.unionByName(new)
