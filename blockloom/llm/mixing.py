"""Mixing sources to target weights with fixed-length token blocks.

Each source's words form one stream (documents in a fixed pseudo-random order), cut into blocks of `block` words. The
output is a row of shards of `shard` slots. Multinomial source counts are drawn per shard, given the sources' totals:
a binary tree over shards is split with multivariate hypergeometric draws seeded by the tree node, so that any shard
finds its counts and its sources' first slots alone, and the totals hold exactly. Slot j of a source of n blocks takes
block perm(j mod n), where perm is a pseudo-random permutation of that source and pass j div n. Blocks are joined by index.

A document is what it holds: id, source and text. Repeated rows are one entry of the stream that is as many times as long,
and share what is taken of it evenly; so reruns agree, whatever the layout of the table. All draws depend on `seed` alone.

A source is used 3 times at most (`most`), so no document exceeds 3 times its size. Null sources are one source, the
last. Null ids are ids like others. Null and empty texts have size 0 and nothing is taken of them. Very long texts are
many blocks. Extra columns are ignored; an empty table gives an empty result. The sources' totals are held by the driver,
as the weights are a setting with an entry for each: over MAX_SOURCES of them are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keep

#: Sources whose totals the driver may hold: the weights are a setting with one entry per source.
MAX_SOURCES = 1_000_000
#: Up to this many sources their table is sent to all tasks; beyond it is joined.
BROADCAST_SOURCES = 20_000


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Share the sum of sizes by weight; what exceeds `most` times a source's size is shared again among the rest."""
    out = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = most * float(sizes[i])
        open_ -= set(full)
        left = float(sum(sizes)) - sum(out[i] for i in range(len(out)) if i not in open_)
    return out


#: Above this population numpy has no sampler without replacement.
LARGE = 10**9


def _split(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of n slots, drawn without replacement from counts, each source gets.

    In a large population every slot is taken with probability n / total first. What is too much of them is given back, or
    what is missing taken, again without replacement: any choice of n slots stays as likely as any other, and the number
    that is left to draw is about the root of the one before.
    """
    total = int(counts.sum())
    if total < LARGE:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    got = rng.binomial(counts, n / total)
    over = int(got.sum()) - n
    if over > 0:
        return got - _split(rng, got, over)
    return got + _split(rng, counts - got, -over) if over else got


def shard_counts(totals: np.ndarray, shards: int, slots: int, which: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First slot and number of slots of every source in one shard."""
    before, here = np.zeros_like(totals), totals.copy()
    low, high, node = 0, shards, 1
    while high - low > 1:
        mid = (low + high) // 2
        left = _split(np.random.default_rng([seed, node]), here, min(int(here.sum()), (mid - low) * slots))
        if which < mid:
            here, high, node = left, mid, 2 * node
        else:
            before, here, low, node = before + left, here - left, mid, 2 * node + 1
    return before, here


def _mixed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser as the round function."""
    with np.errstate(over="ignore"):
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Feistel permutation of [0, n) per row, walked along its cycle until it is inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, n, key = index.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half[todo], x[todo] & mask[todo]
        for r in range(4):
            left, right = right, left ^ (_mixed(right, key[todo] + np.uint64(r)) & mask[todo])
        x[todo] = (left << half[todo]) | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


#: Blocks of a piece of a document's stream: what one row is exploded to at a time.
PIECE = 4096


def _documents(docs: DataFrame, seed: int) -> DataFrame:
    """Distinct documents: doc_id, source, text_key, size, copies, and a digest that orders them."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_key"), words.alias("size"))
    rows = rows.groupBy("doc_id", "source", "text_key", "size").agg(F.count("*").alias("copies"))
    return rows.withColumn("digest", F.xxhash64(F.lit(seed), "doc_id", "text_key", "size"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), block: int = 64, shard: int = 4096, most: float = 3.0, seed: int = 42) -> DataFrame:
    """doc_id, text_key, source, size, source_size, target, taken per row. Weights repeat over the sources in code-point order, null last."""
    spark = docs.sparkSession
    rows = keep(_documents(docs, seed))
    totals = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.count("*").alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources: give weights to groups of sources instead")
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.words for r in totals]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
    blocks = [-(-s // block) for s in sizes]
    slots = [min(int(most * b), round(a * b / s)) if s else 0 for s, a, b in zip(sizes, aims, blocks)]
    # two-level prefix sums: chunks of about the square root of the source's rows
    chunks = [max(1, round(r.docs / max(256, r.docs**0.5))) for r in totals]
    schema = "source string, sid int, source_size long, target double, chunks int"
    table = spark.createDataFrame([(r.source, i, sizes[i], aims[i], chunks[i]) for i, r in enumerate(totals)], schema)
    table = F.broadcast(table) if len(totals) <= BROADCAST_SOURCES else table

    rows = rows.join(table.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("chunk", F.pmod("digest", F.col("chunks")).cast("int")).withColumn("length", F.col("size") * F.col("copies"))
    sums = rows.groupBy("sid", "chunk").agg(F.sum("length").alias("in_chunk"))
    run = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "chunk", F.coalesce(F.sum("in_chunk").over(run), F.lit(0)).alias("base"))
    run = Window.partitionBy("sid", "chunk").orderBy("digest", "doc_id", "text_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("length").over(run), F.lit(0)))
    rows = rows.join(sums, ["sid", "chunk"]).withColumn("start", F.col("start") + F.col("base")).drop("chunk", "chunks", "base")
    rows = keep(rows)

    # a document's blocks, piece by piece
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("length") - 1) / block)
    key = ("sid", "doc_id", "text_key", "size")
    pieces = rows.where("length > 0").select(*key, "start", "length", F.explode(F.sequence(F.floor(first / PIECE), F.floor(last / PIECE))).alias("piece"))
    spans = pieces.select(*key, "start", "length", F.explode(F.sequence(F.greatest(first, F.col("piece") * PIECE), F.least(last, F.col("piece") * PIECE + PIECE - 1))).alias("block"))
    spans = spans.select(*key, "block", (F.least(F.col("start") + F.col("length"), (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)).alias("words"))

    count, n_blocks = np.array(slots, np.int64), np.array(blocks, np.int64)
    shards = max(1, -(-int(count.sum()) // shard))

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for which in part["id"]:
                first, n = shard_counts(count, shards, shard, int(which), seed)
                sid = np.repeat(np.arange(len(n)), n)
                slot = np.concatenate([np.arange(f, f + k) for f, k in zip(first[n > 0], n[n > 0])] or [np.empty(0, np.int64)])
                of = n_blocks[sid]
                turn = slot // of
                key = _mixed(sid.astype(np.uint64) * np.uint64(1 << 20) + turn.astype(np.uint64), np.uint64(seed)) if len(sid) else sid.astype(np.uint64)
                yield pd.DataFrame({"sid": sid.astype(np.int32), "block": permuted(slot % of, of, key) if len(sid) else slot})

    tasks = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    drawn = spark.range(0, shards if len(totals) else 0, 1, tasks).mapInPandas(draw, "sid int, block long")
    times = drawn.groupBy("sid", "block").agg(F.count("*").alias("times"))
    # the drawn table grows with the input, though Spark takes its size from the range it starts with
    taken = spans.join(times.hint("merge"), ["sid", "block"]).groupBy(*key).agg(F.sum(F.col("words") * F.col("times")).alias("of_all"))
    taken = taken.select(*[F.col(k).alias(f"of_{k}") for k in key], "of_all")
    same = F.col("of_sid") == F.col("sid")
    for k in key[1:]:
        same = same & F.col(f"of_{k}").eqNullSafe(F.col(k))
    out = rows.join(taken, same, "left").withColumn("of_all", F.coalesce("of_all", F.lit(0)).cast("long"))
    # copies share evenly; what doesn't divide goes to the first ones, a word each
    out = out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    share = F.floor(F.col("of_all") / F.col("copies")) + (F.col("copy") <= F.col("of_all") % F.col("copies")).cast("long")
    return out.select("doc_id", "text_key", "source", "size", "source_size", "target", share.alias("taken"))


def mixed(docs: DataFrame, seed: int = 42, **options) -> DataFrame:
    """docs as the mix takes them, all columns kept: each whole document as often as its words are taken on average.

    What is left of a whole number of times is decided by a hash of the document, so that sources keep their totals.
    Documents without words are kept once. Repeated rows, null ids and null sources are documents like others.
    """
    taken = mix(docs, seed=seed, **options)
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_key"), F.lit(1 << 20)) / (1 << 20)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + chance)).otherwise(1)
    times = taken.groupBy("doc_id", "source", "text_key").agg(F.round(F.avg(times)).cast("int").alias("times")).where("times > 0")
    times = times.select(F.col("doc_id").alias("of_id"), F.col("source").alias("of_source"), F.col("text_key").alias("of_text"), "times")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_key"))
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & F.col("source").eqNullSafe(F.col("of_source")) & (F.col("text_key") == F.col("of_text"))
    out = rows.join(times.hint("merge"), same).select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select("row.*")


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, size, source_size, target, taken, over all documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "source", "size", "source_size", "target", "taken")
