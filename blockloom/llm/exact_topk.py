"""Exact top-k by inner product: tiles of query blocks times vector shards, partial selection, tree merging.

Queries and vectors are dealt over a grid: a cell holds one block of queries and one shard of vectors, so that a vector
travels once per query block and a query once per shard, and a cell's size is bounded. A cell multiplies tile by tile,
keeps the best k of each tile per query and merges them as it goes. Cells' lists are merged in a tree of fan-in 16.

Components become floor(scale * x) with x as double. Vectors that are null or hold a null or non-finite component take no
part. Vectors of another length than the query's are no candidates of it. Rows whose vec_id is null take no part. A query
never meets rows with its own vec_id; repeated rows of another id are candidates each; queries that repeat an id give one
list. Ties go to the smaller vec_id. Products beyond a long saturate. Extra columns are ignored; an empty table, or one
without queries, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, partitions

#: Largest cell: queries by vectors, and the part of it that is multiplied at once.
QUERY_BLOCK, SHARD, TILE = 4096, 32768, 2048
FAN_IN = 16


def quantised(embedding: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) per component, as doubles (exact); null where the vector takes no part."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    big = F.transform(x, lambda v: v * scale)
    # floor() of a double gives a long, so very large values (which are whole) are left as they are
    return F.when(fine, F.transform(big, lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exact, as longs."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if bound < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in a.tolist()], object) @ np.array([[int(v) for v in r] for r in b.tolist()], object).T
    return np.array([[min(max(v, -(2**63)), 2**63 - 1) for v in r] for r in exact.tolist()], np.int64)


def best(score: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per row the k best (score, id): ids ascend along the columns, so the first of equal scores is the smaller id."""
    low, high = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
    barred = [(r, i, j) for r, (i, j) in enumerate(zip(low.tolist(), high.tolist())) if i < j]
    usable = np.ones(score.shape, bool) if barred else None
    for r, i, j in barred:
        usable[r, i:j] = False
    rows = []
    n = score.shape[1]
    if n > k and not barred:
        cut = np.partition(score, n - k, axis=1)[:, n - k]
        more = score > cut[:, None]
        tied = score == cut[:, None]
        need = k - more.sum(axis=1)
        chosen = more | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= need[:, None]))
        at = np.nonzero(chosen)[1].reshape(len(score), k)
        return [(score[r, c], ids[c]) for r, c in enumerate(at)]
    for r in range(len(score)):
        s, i = (score[r][usable[r]], ids[usable[r]]) if barred else (score[r], ids)
        if len(s) > 4 * k:
            cut = np.partition(s, len(s) - k)[len(s) - k]
            more = np.flatnonzero(s > cut)
            at = np.sort(np.concatenate((more, np.flatnonzero(s == cut)[: k - len(more)])))
            s, i = s[at], i[at]
        rows.append((s, i))
    return rows


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.lexsort((ids, -score.astype(np.float64) if score.dtype == object else ~score))[:k]
    return score[at], ids[at]


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for every row whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v"))
    rows = keep(rows.where("vec_id is not null and v is not null"))
    asks = F.col("vec_id") % every == 0
    n, q = rows.select(F.count("*"), F.count_if(asks)).first()
    # at least as many cells as tasks; more where a cell would grow beyond its bounds
    blocks = max(1, -(-q // QUERY_BLOCK))
    shards = max(1, -(-n // SHARD), min(-(-n // TILE), -(-2 * partitions(spark) // blocks)))
    salt = F.monotonically_increasing_id()
    shard = F.pmod(F.xxhash64(F.lit(1), "vec_id", salt), shards).cast("int")
    block = F.pmod(F.xxhash64(F.lit(2), "vec_id", salt), blocks).cast("int")
    own = rows.select("vec_id", "v", shard.alias("shard")).select(F.lit(False).alias("asks"), "vec_id", "v", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    ask = rows.where(asks).select("vec_id", "v", block.alias("block")).select(F.lit(True).alias("asks"), "vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block")
    cells = own.unionByName(ask)

    def cell(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids, is_query = table["vec_id"].to_numpy(), table["asks"].to_numpy(zero_copy_only=False)
        column = table["v"].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        size = np.diff(column.offsets.to_numpy())
        lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d in np.unique(size).tolist():
            same = size == d
            flat = column.filter(pa.array(same)).flatten().to_numpy().reshape(int(same.sum()), d)
            asked = is_query[same]
            qs, qi, cs, ci = flat[asked], ids[same][asked], flat[~asked], ids[same][~asked]
            order = np.argsort(ci, kind="stable")
            cs, ci = cs[order], ci[order]
            for a in range(0, len(qs), TILE // 4):
                for c in range(0, len(cs), TILE):
                    tile = best(products(qs[a : a + TILE // 4], cs[c : c + TILE]), ci[c : c + TILE], qi[a : a + TILE // 4], k)
                    for query, (s, i) in zip(qi[a : a + TILE // 4].tolist(), tile):
                        if query in lists:
                            s, i = np.concatenate((lists[query][0], s)), np.concatenate((lists[query][1], i))
                        lists[query] = _top(s, i, k)
        named = sorted(lists)
        pairs = [[{"loss": ~int(s), "vec_id": int(i)} for s, i in zip(*lists[x])] for x in named]
        kind = pa.list_(pa.struct([("loss", pa.int64()), ("vec_id", pa.int64())]))
        cols = [pa.array(named, pa.int64()), pa.array([key[0].as_py() if hasattr(key[0], "as_py") else key[0]] * len(named), pa.int32()), pa.array(pairs, kind)]
        yield pa.RecordBatch.from_arrays(cols, names=["query_id", "part", "top"])

    def whole(table: pa.Table) -> pa.Table:
        key = (table["shard"][0],)
        return pa.Table.from_batches(cell(key, iter(table.to_batches())))

    lists = cells.groupBy("shard", "block").applyInArrow(whole, "query_id long, part int, top array<struct<loss: long, vec_id: long>>")
    parts = shards
    while True:  # loss = ~score, so that ascending order puts the best first and smaller ids before larger
        parts = -(-parts // FAN_IN)
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k)
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("query_id", "part").agg(merged.alias("top"))
        if parts <= 1:
            break
    out = lists.select("query_id", F.posexplode("top").alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.bitwise_not(F.col("hit.loss")).alias("score"))


def op1_exact_topk(spark, sf_dir: str) -> DataFrame:
    """Contract query: the 5 best of every row for queries with vec_id divisible by 50."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
