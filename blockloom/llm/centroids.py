"""Centroid clustering of integer vectors by delta Lloyd rounds: exact results, and work that shrinks with what moves.

vectors  are written once, in buckets by row number;
owners   each round writes every row's owner and distance in the same buckets, so that the two meet without a shuffle. Rows
         whose own centroid moved are compared with all centroids; all others only with the centroids that changed, since
         the rest were no nearer before and have not moved;
sums     the exact sum and count of every cluster, kept from round to round. A vector that changed its owner sends its
         components with a minus sign to the old cluster and with a plus sign to the new one. Transfers are summed up in
         each task, so a cluster that holds most rows costs no more than another, and then over all tasks.

Vectors and owners are kept in the shared folder, so a lost executor costs one round's tasks. The driver holds the centroids
and sums only: at most MOST_NUMBERS numbers each, else ValueError. When no centroid changes the remaining rounds would repeat the last one and are left out.

Components become floor(scale * x), x as double, and saturate at a long. Vectors that are null, of another length, or with a
null or non-finite component take no part. Repeated rows and repeated or null ids are vectors like others; a null id counts
as the empty text in the starting order, whose ties go by the components. With fewer vectors than clusters there are as many
clusters as vectors. Equal distances go to the smaller number. Distances beyond a long saturate in the result. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed

#: Most numbers of all centroids together: they go to every task.
MOST_NUMBERS = 1 << 22
LAST = 2**63 - 1
OWNERS = "row long, vec_id long, was int, owner int, distance long, moved array<long>"


def kept(vectors: DataFrame, dims: int, scale: float) -> DataFrame:
    """(vec_id, v): the vectors that take part, as whole numbers."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.where((F.size("embedding") == dims) & fine)
    whole = F.transform(x, lambda c: F.when(F.abs(c * scale) < 2.0**62, F.floor(c * scale)).otherwise(F.when(c > 0, F.lit(LAST)).otherwise(F.lit(-LAST))))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def first_centroids(stored: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors with the least lowercase-hex SHA-256 of `seed:vec_id`, ties by the components."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    return [r.v for r in stored.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of v to all rows of c: exact longs, or Python integers where those don't fit."""
    most = max(int(abs(v).max(initial=0)), int(abs(c).max(initial=0)))
    if 4 * most * most * max(1, v.shape[1]) < 1 << 53:  # every product and sum is a whole double
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((v.astype(object) - row) ** 2).sum(axis=1) for row in c.astype(object)], axis=1)


def nearest(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, c: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owner and distance of each row; owner is -1 where there is none yet."""
    owner, distance = owner.copy(), distance.astype(object) if len(distance) and distance.max() == LAST else distance.copy()
    whole = (owner < 0) | changed[owner] | (distance == LAST)  # a distance at the bound may be a larger one
    few = np.flatnonzero(changed)
    rest = np.flatnonzero(~whole)
    if len(few) and len(rest):
        d = distances(v[rest], c[few])
        j = d.argmin(axis=1)
        d, j = d[np.arange(len(rest)), j], few[j]
        better = (d < distance[rest]) | ((d == distance[rest]) & (j < owner[rest]))
        owner[rest[better]], distance[rest[better]] = j[better], d[better]
    at = np.flatnonzero(whole)
    if len(at):
        d = distances(v[at], c)
        j = d.argmin(axis=1)
        d = d[np.arange(len(at)), j]
        owner[at], distance[at] = j, np.minimum(d, LAST) if d.dtype == object else d
    return owner, distance.astype(np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def assigned(rows: DataFrame, centroids: list[list[int]], changed: list[bool], dims: int) -> DataFrame:
    """OWNERS of rows (row, vec_id, v, owner, distance); moved: the vector, where its owner changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64).reshape(-1, dims)
        new = np.array(changed, bool)
        for b in batches:
            was = b.column(3).to_numpy(zero_copy_only=False).astype(np.int32)
            owner, distance = nearest(_matrix(b.column(2), dims), was, b.column(4).to_numpy(zero_copy_only=False).astype(np.int64), c, new)
            moved = pa.compute.if_else(pa.array(owner != was), b.column(2), pa.scalar(None, b.column(2).type))
            cols = [b.column(0), b.column(1), pa.array(was, pa.int32()), pa.array(owner.astype(np.int32)), pa.array(distance), moved]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "vec_id", "was", "owner", "distance", "moved"])

    return rows.select("row", "vec_id", "v", "owner", "distance").mapInArrow(run, OWNERS)


def transfers(owners: DataFrame, dims: int) -> DataFrame:
    """(cluster, dim, delta): signed sums of what moved, a few rows per task; dim -1 is the number of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, out = _matrix(b.column(2), dims), []
            step = max(1, (1 << 62) // max(1, int(abs(v).max(initial=0))))  # so many rows add up within a long
            for k in range(0, len(v), step):
                for sign, side in ((-1, b.column(0)), (1, b.column(1))):
                    of = side.to_numpy(zero_copy_only=False)[k : k + step]
                    for j in np.unique(of[of >= 0]):
                        mine = v[k : k + step][of == j]
                        out.append((int(j), sign * np.append(mine.sum(axis=0), len(mine))))
            if out:
                dim = np.tile(np.append(np.arange(dims), -1), len(out)).astype(np.int32)
                cluster = np.repeat(np.array([j for j, _ in out], np.int32), dims + 1)
                yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(dim), pa.array(np.concatenate([d for _, d in out]))], names=["cluster", "dim", "delta"])

    return owners.where("moved is not null").select("was", "owner", "moved").mapInArrow(run, "cluster int, dim int, delta long")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, seed: str = "3") -> tuple[DataFrame, list[list[int]]]:
    """(row, vec_id, owner, distance) of every vector that takes part, after `rounds` rounds and a last assignment; the centroids."""
    if k * dims > MOST_NUMBERS:
        raise ValueError(f"{k} centroids of {dims} components are over {MOST_NUMBERS} numbers")
    stored = bucketed(kept(vectors, dims, scale).withColumn("row", F.monotonically_increasing_id()), "row")
    centroids = first_centroids(stored, k, seed)
    changed = [True] * len(centroids)
    owners, sums = None, {}
    for done in range(rounds + 1):
        if owners is None:
            rows = stored.withColumns({"owner": F.lit(-1), "distance": F.lit(0).cast("long")})
        else:
            rows = stored.join(owners.select("row", "owner", "distance").hint("merge"), "row")
        owners = bucketed(assigned(rows, centroids, changed, dims), "row")
        if not centroids:
            break
        for r in transfers(owners, dims).groupBy("cluster", "dim").agg(F.sum(F.col("delta").cast("decimal(38,0)")).alias("total")).collect():
            sums[r.cluster, r.dim] = sums.get((r.cluster, r.dim), 0) + int(r.total)  # k * (dims + 1) numbers
        if done == rounds:
            break
        after = [[sums[j, i] // sums[j, -1] for i in range(dims)] if sums.get((j, -1)) else c for j, c in enumerate(centroids)]
        changed = [a != b for a, b in zip(after, centroids)]
        if not any(changed):
            break
        centroids = after
    return owners.select("row", "vec_id", "owner", "distance"), centroids


def saturated(total: Column) -> Column:
    return F.least(total, F.lit(LAST).cast("decimal(38,0)")).cast("long")


def clusters(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark: SparkSession = vectors.sparkSession
    owners, centroids = cluster(vectors, **options)
    per = owners.groupBy("owner").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()  # a row for each cluster
    whole = sum(int(r.own) for r in per)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    told = spark.createDataFrame([(r.owner, min(int(r.own), LAST), min(whole, LAST), sha[r.owner]) for r in per], "owner int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = owners.join(F.broadcast(told), "owner")
    return out.select("vec_id", F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


_ROUND = """
a{r} AS MATERIALIZED (
  SELECT v.r, min({{'d': CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), 'c': c.c}}) AS m
  FROM v, c{r} AS c GROUP BY v.r)"""
_MEANS = """
c{n} AS MATERIALIZED (
  SELECT c.c, coalesce(n.e, c.e) AS e
  FROM c{r} AS c LEFT JOIN (
    SELECT c, list(q ORDER BY i) AS e FROM (
      SELECT a.m.c AS c, x.i, CAST((sum(x.x) - ((sum(x.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS q
      FROM a{r} AS a JOIN x ON a.r = x.r GROUP BY a.m.c, x.i) GROUP BY c) AS n ON n.c = c.c)"""

OP11_SQL = (
    """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, e) - 1 AS INTEGER) AS c, e
  FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, e FROM v ORDER BY h, e LIMIT 8)),"""
    + ",".join(_ROUND.format(r=r) + "," + _MEANS.format(r=r, n=r + 1) for r in range(10))
    + ","
    + _ROUND.format(r=10)
    + """
SELECT v.vec_id, a.m.c AS cluster, a.m.d AS distance,
       CAST(sum(a.m.d) OVER (PARTITION BY a.m.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.m.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c.e, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM a10 AS a JOIN v ON v.r = a.r JOIN c10 AS c ON c.c = a.m.c
"""
)
