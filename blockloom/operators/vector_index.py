"""A stored vector index: rows by nearest pivot and distance to it, whose bounds rule shards out while results stay exact.

Vectors have length 1 (or 0), so a cosine is (|q|^2 + |x|^2 - |q - x|^2) / 2. A shard holds the rows of one pivot within one
ring of distances to it. By the triangle inequality no row of it is nearer to a query than the query's own distance to the
pivot leaves room for. Each batch of rows is written with the bounds of its own shards, which are also its commit: a batch
without them is not read, and a batch that is there is not written again.

On disk: `pivots` (number, vector), `rows/batch=B/pivot=P` sorted by shard, `bounds/batch=B` (shard, n, lo, hi).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import written
from . import embedding
from .embedding import BLOCK, LISTS, SHARD, TOP, matrix, merged, unit

#: Rings per pivot: distances lie in [0, 2]. Rows without a direction are a shard of their own behind the others.
RINGS = 40
#: Rows that pivots are fitted on (those of least mixed id), rounds of fitting, rows that a query's first shards should hold.
SAMPLE, ROUNDS, PROBE = 4096, 10, 1024
#: What rounding may move a distance by.
SLACK = 1e-7
ROWS = "id bigint, v array<double>, shard int, dist double"


@dataclass(frozen=True)
class VectorIndex:
    """An index at a path that driver and executors share; pivots is (number of pivots) x (dimensions)."""

    spark: SparkSession
    path: str
    pivots: np.ndarray

    @property
    def dim(self) -> int:
        return self.pivots.shape[1]

    @property
    def nowhere(self) -> int:
        """The shard of rows of length 0."""
        return len(self.pivots) * RINGS

    def bounds(self) -> DataFrame:
        """(batch, shard, n, lo, hi) of all batches: at most pivots x rings + 1 rows a batch."""
        schema = "shard int, n bigint, lo double, hi double, batch string"
        if not _there(self.spark, f"{self.path}/bounds"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/bounds")


def _there(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _clean(rows: DataFrame, key: str, vec: str) -> DataFrame:
    v = F.col(vec).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col(key).isNotNull() & F.col(vec).isNotNull() & ~odd).select(F.col(key).cast("bigint").alias(key), v.alias("v"))


def _fit(sample: np.ndarray, n: int) -> np.ndarray:
    """n centres of a sample (fewer if it has fewer distinct rows)."""
    sample = np.unique(sample, axis=0)
    picked, far = [0], np.full(len(sample), np.inf)
    while len(picked) < min(n, len(sample)):  # the row farthest from those picked so far
        far = np.minimum(far, _distances(sample, sample[picked[-1:]])[:, 0])
        picked.append(int(np.argmax(far)))
    centres = sample[picked]
    for _ in range(ROUNDS):
        owner = np.argmin(_distances(sample, centres), axis=1)
        sizes = np.bincount(owner, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, sample)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))


def create(rows: DataFrame, path: str, pivots: int = 64, vec: str = "embedding", batch: str = "0") -> VectorIndex:
    """An index of rows (id, vec) at a new path. Pivots are fitted on a sample of SAMPLE rows, which sets speed, not results.

    The first row's length is the index's; append() says which rows are taken.
    """
    spark = rows.sparkSession
    clean = _clean(rows, "id", vec)
    sample = clean.where(F.size("v") > 0).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).withColumn("v", unit(F.col("v"))).toArrow()
    if not len(sample):
        raise ValueError("an index needs a row to start with")
    dim = len(sample["v"][0])
    same = [v for v in sample["v"].to_pylist() if len(v) == dim]
    centres = _fit(np.array(same, dtype=float), pivots)
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "pivot int, v array<double>")
    table.coalesce(1).write.parquet(f"{path}/pivots")
    index = VectorIndex(spark, path, centres)
    append(index, rows, batch, vec)
    return index


def load(spark: SparkSession, path: str) -> VectorIndex:
    found = sorted(spark.read.parquet(f"{path}/pivots").collect(), key=lambda r: r.pivot)
    return VectorIndex(spark, path, np.array([r.v for r in found], dtype=float))


def append(index: VectorIndex, rows: DataFrame, batch: str, vec: str = "embedding") -> bool:
    """Add rows (id, vec) as a batch; False if a batch of this name is there already. Vectors get length 1.

    Rows with a null id, a null vector or a component that is null or not finite are left out, as they can't be compared;
    rows of another length than the index's are an error, before anything is written.
    """
    if _there(index.spark, f"{index.path}/bounds/batch={batch}/_SUCCESS"):
        return False
    clean = _clean(rows, "id", vec)
    if not clean.where(F.size("v") != index.dim).isEmpty():
        raise ValueError(f"vectors must have {index.dim} dimensions")
    centres, nowhere, dim = index.pivots, index.nowhere, index.dim

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column(1), dim)
            d = _distances(v, centres)
            owner = np.argmin(d, axis=1)
            dist = d[np.arange(len(v)), owner]
            ring = np.minimum((dist * RINGS / 2).astype(np.int32), RINGS - 1)
            shard = np.where(v.any(axis=1), owner * RINGS + ring, nowhere).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shard), pa.array(dist)], names=["id", "v", "shard", "dist"])

    at = f"{index.path}/rows/batch={batch}"
    placed = clean.withColumn("v", unit(F.col("v"))).mapInArrow(place, ROWS).withColumns({"salt": F.monotonically_increasing_id(), "pivot": F.floor(F.col("shard") / RINGS).cast("int")})
    placed.sortWithinPartitions("pivot", "shard").write.mode("overwrite").partitionBy("pivot").parquet(at)
    stored = index.spark.read.schema(ROWS).parquet(at)
    bounds = stored.groupBy("shard").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    bounds.coalesce(1).write.mode("overwrite").parquet(f"{index.path}/bounds/batch={batch}")
    return True


@dataclass(frozen=True)
class _Shards:
    """The bounds of all shards over all batches, and what they say about queries."""

    pivots: np.ndarray
    shard: np.ndarray
    n: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def best(self, queries: np.ndarray) -> np.ndarray:
        """(queries x shards): no row of the shard has a larger cosine."""
        length = queries.any(axis=1).astype(float)[:, None]
        pivot = self.shard // RINGS
        lost = pivot >= len(self.pivots)
        d = _distances(queries, self.pivots)[:, np.where(lost, 0, pivot)]
        least = np.maximum(0.0, np.maximum(d - self.hi, self.lo - d) - SLACK)
        most = np.minimum((length**2 + 1 - least**2) / 2, length)
        return np.where(lost[None, :], 0.0, most)

    def first(self, best: np.ndarray, least: int) -> np.ndarray:
        """(queries x shards): the most promising shards, until they hold a number of rows."""
        order = np.argsort(-best, axis=1, kind="stable")
        held = np.cumsum(self.n[order], axis=1) - self.n[order]
        out = np.zeros(best.shape, bool)
        np.put_along_axis(out, order, held < least, axis=1)
        return out


def _planned(index: VectorIndex, queries: DataFrame, shards: _Shards, k: int) -> DataFrame:
    """(query_id, v, shard): where queries are still to be asked; without a column `floor`, their first shards."""
    dim, later, least = index.dim, "floor" in queries.columns, max(k, PROBE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = shards.best(matrix(b.column(1), dim))
            go = shards.first(best, least)
            if later:
                go = ~go & (best + SLACK >= b.column(2).to_numpy(zero_copy_only=False)[:, None])
            for at in range(0, len(go), 256):
                row, col = np.nonzero(go[at : at + 256])
                some = pa.array(row + at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(some), b.column(1).take(some), pa.array(shards.shard[col].astype(np.int32))], names=["query_id", "v", "shard"])

    return queries.mapInArrow(run, "query_id bigint, v array<double>, shard int")


def _asked(index: VectorIndex, plan: DataFrame, shards: _Shards, k: int) -> DataFrame:
    """Lists of the k best rows for (query, shard) pairs. Large shards are cut into slices, many queries into blocks."""
    spark, dim = index.spark, index.dim
    wanted = {r.shard: -(-r["count"] // BLOCK) for r in plan.groupBy("shard").count().collect()}  # a row per shard
    if not wanted:
        return spark.createDataFrame([], TOP)
    sizes = dict(zip(shards.shard.tolist(), shards.n.tolist()))
    cells = spark.createDataFrame([(s, -(-sizes[s] // SHARD), b) for s, b in wanted.items()], "shard int, slices bigint, blocks bigint")
    rows = spark.read.schema(ROWS + ", salt bigint, batch string, pivot int").parquet(f"{index.path}/rows")
    batches = [r.batch for r in index.bounds().select("batch").distinct().collect()]
    rows = rows.where(F.col("batch").isin(batches) & F.col("pivot").isin(sorted({s // RINGS for s in wanted})) & F.col("shard").isin(sorted(wanted)))

    def every(n: str):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    cut = F.broadcast(cells)  # at most pivots x rings + 1 rows
    own = rows.join(cut, "shard").select("shard", F.pmod("salt", "slices").alias("slice"), every("blocks").alias("block"), "id", "v")
    ask = plan.join(cut, "shard").select("shard", every("slices").alias("slice"), F.pmod(F.xxhash64("query_id"), F.col("blocks")).alias("block"), "query_id", "v")

    def cell(key: tuple, some: pa.Table, to: pa.Table) -> pa.Table:
        if not len(to):
            return pa.Table.from_batches([embedding.Best(np.empty(0, np.int64), np.zeros((0, dim)), k).rows(0)])
        best = embedding.Best(to["query_id"].to_numpy(), matrix(to["v"], dim), k)
        best.add(some["id"].to_numpy(), matrix(some["v"], dim))
        return pa.Table.from_batches([best.rows((key[0].as_py() + key[1].as_py()) % LISTS)])

    keys = ("shard", "slice", "block")
    return own.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInArrow(cell, TOP)


def _steps(index: VectorIndex, queries: DataFrame, k: int, vec: str) -> tuple[_Shards, DataFrame, DataFrame, DataFrame]:
    """Shards, first plan, lists of the first plan by query, second plan."""
    found = index.bounds().groupBy("shard").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("shard").toArrow()
    shards = _Shards(index.pivots, *[found[c].to_numpy() for c in ("shard", "n", "lo", "hi")])
    q = written(_clean(queries, "query_id", vec).where(F.size("v") == index.dim).withColumn("v", unit(F.col("v"))))
    first = _planned(index, q, shards, k)
    lists = written(merged(_asked(index, first, shards, k), LISTS, k))
    floor = F.when(F.size("top") >= k, -F.element_at("top", -1)["loss"]).otherwise(float("-inf"))
    known = q.join(lists.select("query_id", floor.alias("floor")), "query_id").select("query_id", "v", "floor")
    return shards, first, lists, written(_planned(index, known, shards, k))


def search(index: VectorIndex, queries: DataFrame, k: int = 5, vec: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k rows with the largest cosine per row of queries (query_id, vec), exactly.

    Same rows as embedding.search over the same vectors: ties go to the larger id, queries of another length, with a null id or
    with components that are null or not finite give no rows. A query is asked where it may find most first; the k-th score
    found there rules out every shard whose bounds stay below it, and the others are asked as well.
    """
    shards, _, lists, rest = _steps(index, queries, k, vec)
    more = _asked(index, rest, shards, k)
    return embedding.ranked(merged(lists.unionByName(more), LISTS, k))


def pruning(index: VectorIndex, queries: DataFrame, k: int = 5, vec: str = "embedding") -> DataFrame:
    """(query_id, shards_asked, shards, rows_asked, rows): how much of the index search() compares a query with."""
    shards, first, _, rest = _steps(index, queries, k, vec)
    sizes = index.bounds().groupBy("shard").agg(F.sum("n").alias("n"))
    asked = first.unionByName(rest).select("query_id", "shard").join(F.broadcast(sizes), "shard")
    return asked.groupBy("query_id").agg(F.count("*").alias("shards_asked"), F.lit(len(shards.shard)).cast("bigint").alias("shards"), F.sum("n").alias("rows_asked"), F.lit(int(shards.n.sum())).cast("bigint").alias("rows"))
