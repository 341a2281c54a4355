"""The trie of all conversation prefixes as preorder intervals: leaves and savings are differences of running sums.

turns     the first 128 bits of the SHA-256 of role and text stand for a turn; no text is shuffled. A turn's place in its
          conversation comes from a running count over the table sorted by range, so a conversation of any length is cut
          over tasks. Conversations are rebuilt from the head of their group's first one and their own rest;
nodes     a prefix is named by two running polynomial sums over its turns (128 bits), so equal prefixes meet in a groupBy. That
          all members of a node have the same last turn and the same parent is checked; by induction their whole prefixes
          are equal. If not, the sums are taken with other factors;
paths     every node belongs to the path of the member whose mixed id is least: the trie falls into paths, and from the root
          to any node the path changes some ln(members) times only, whatever the trie's shape, as a part's least member is
          the whole's with the chance of its share. A path's key is where it leaves its parent path, after that path's own
          key; keys grow by pointer doubling;
preorder  nodes are ranked by (key of the path, depth), which lists every subtree in one piece; a marker after each path is
          the end of the subtree of all its nodes. Running sums over this order, by range, give the number of leaves and
          the bytes saved before each node and each marker; their difference is what the subtree holds;
ends      decimal ids of the conversations that end in a node, sorted by range, are joined to pieces in all tasks; as SHA-256
          takes its bytes one after the other, one task reads the pieces of a node as a stream.

Null roles and texts are empty. Turns go by turn (null first), ties by the 128 bits, so repeated rows are turns of their own.
Rows without a conv_id are in no conversation. A conversation without turns after rebuilding ends in the root. Texts are
hashed whole. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined_hot, keep, written
from .scans import counted, in_order, segments, summed

WORD64 = (1 << 64) - 1
#: Odd factors of the two running sums; further pairs are for a clash.
FACTORS = [(0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xBF58476D1CE4E5B9, 0x94D049BB133111EB), (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: Ids in one piece of a node's list.
PIECE = 1 << 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, x, y, bytes): each turn with the two halves of its digest and the UTF-8 length of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)

    def half(k: int) -> Column:  # 64 bits as a signed long
        high, low = (F.conv(F.substring(digest, 1 + 16 * k + 8 * j, 8), 16, 10).cast("long") for j in (0, 1))
        return F.shiftleft(high, 32).bitwiseOR(low)

    named = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), half(0).alias("x"), half(1).alias("y"), F.octet_length(text).cast("long").alias("bytes"))
    return named.where("conv_id is not null")


def rebuilt(rows: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conv_id, own, ord, x, y, bytes): the turns of all rebuilt conversations, to be ordered by (own, ord); and all conv_ids.

    rows: turns with ord. A conversation takes the first h turns of conversation conv_id - conv_id % group, then its own
    turns after its first h; h = crc32(decimal conv_id) % heads.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    every = rows.where("ord = 1").select("conv_id")
    own = rows.where(F.col("ord") > h).select("conv_id", F.lit(1).alias("own"), "ord", "x", "y", "bytes")
    first = rows.where((F.col("ord") < heads) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("of"), "ord", "x", "y", "bytes")
    takes = every.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("of"), h.alias("h"))
    head = takes.join(first, "of").where("ord <= h").select("conv_id", F.lit(0).alias("own"), "ord", "x", "y", "bytes")
    return own.unionByName(head), every


PREFIXES = "conv_id long, depth long, a long, b long, up_a long, up_b long, bytes long, x long, y long"


def prefixes(rows: DataFrame, factors: tuple[int, int]) -> DataFrame:
    """Every rebuilt turn as the prefix that ends with it: its depth, its two sums, its parent's, and its last turn.

    With q a factor, a prefix's sum is x1 + x2 q + x3 q^2 ... (mod 2^64). A part of the sorted table that goes on with a
    conversation of an earlier part has begun at 1 again; what is missing is one factor and one addend for the part.
    """
    q = [np.uint64(f) for f in factors]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, depth, power, total = TaskContext.get().partitionId(), None, 0, [np.uint64(1)] * 2, [np.uint64(0)] * 2
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column(0).to_numpy()
            first, at = segments(conv, last), np.arange(len(conv))
            goes_on, since = first < 0, at - np.maximum(first, 0)
            steps = since + np.where(goes_on, depth, 0)
            sums = []
            for k in (0, 1):
                x = b.column(3 + k).to_numpy().view(np.uint64)
                powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(int(since.max()), q[k]))))
                weight = powers[since] * np.where(goes_on, power[k], np.uint64(1))
                add = x * weight
                run_sum = np.cumsum(add, dtype=np.uint64)
                start = np.maximum(first, 0)
                own = run_sum - (run_sum[start] - add[start]) + np.where(goes_on, total[k], np.uint64(0))
                sums += [own, own - add]
                power[k], total[k] = (weight[-1:] * q[k])[0], own[-1]
            last, depth = int(conv[-1]), int(steps[-1]) + 1
            cols = [b.column(0), pa.array(steps + 1), *[pa.array(s.view(np.int64)) for s in (sums[0], sums[2], sums[1], sums[3])], b.column(5), b.column(3), b.column(4), pa.array(np.full(len(conv), part, np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "depth", "a", "b", "up_a", "up_b", "bytes", "x", "y", "part"])

    sorted_rows = in_order(rows.select("conv_id", "own", "ord", "x", "y", "bytes"), "conv_id", "own", "ord")
    local = written(sorted_rows.mapInArrow(run, PREFIXES + ", part int"))
    end = F.max(F.struct("conv_id", "depth", "a", "b"))
    parts = local.groupBy("part").agg(F.min("conv_id").alias("first"), end.alias("end")).orderBy("part").collect()
    carry, before, held = {}, None, (0, 0, 0)
    for r in parts:
        depth, a, b = held if r.first == before else (0, 0, 0)
        carry[r.part] = (r.first, depth, a, b)
        more = (depth, a, b) if r.end.conv_id == r.first else (0, 0, 0)
        scale = [pow(f, more[0], 1 << 64) for f in factors]
        held = (more[0] + r.end.depth, (more[1] + scale[0] * (r.end.a & WORD64)) & WORD64, (more[2] + scale[1] * (r.end.b & WORD64)) & WORD64)
        before = r.end.conv_id
    whole = pa.schema([(n, pa.int64()) for n in ("conv_id", "depth", "a", "b", "up_a", "up_b", "bytes", "x", "y")])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, conv = b.column(9).to_numpy(), b.column(0).to_numpy()
            cols = [c.to_numpy() for c in b.columns[1:6]]
            for p in np.unique(part):
                first, depth, *sums = carry[int(p)]
                if depth:
                    mine = (part == p) & (conv == first)
                    for k, s in enumerate((sums[0], sums[1], sums[0], sums[1])):
                        scaled = cols[1 + k].view(np.uint64) * np.uint64(pow(factors[k % 2], depth, 1 << 64)) + np.uint64(s)
                        cols[1 + k] = np.where(mine, scaled.view(np.int64), cols[1 + k])
                    cols[0] = np.where(mine, cols[0] + depth, cols[0])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in cols], *b.columns[6:9]], schema=whole)

    return local.mapInArrow(finish, PREFIXES)


def nodes(rows: DataFrame) -> DataFrame | None:
    """One row per distinct prefix: its parent's name, its least member, how many members, its path. None if two prefixes clash."""
    same = [F.min(c).alias(c) for c in ("up_a", "up_b", "x", "y", "bytes")]
    other = [F.max(c).alias(f"most_{c}") for c in ("up_a", "up_b", "x", "y")]
    found = rows.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min(F.xxhash64("conv_id")).alias("path"), *same, *other)
    found = written(found)
    clash = " or ".join(f"{c} <> most_{c}" for c in ("up_a", "up_b", "x", "y"))
    if not found.where(clash).isEmpty():
        return None
    return found.select("depth", "a", "b", "up_a", "up_b", "conv_id", "n_convs", "path", "bytes")


def path_keys(tops: DataFrame, root_path: int) -> DataFrame:
    """(path, key) of every path of tops (path, up, depth): where it leaves the path `up`, after the key of that one."""
    at = F.array(2 * F.col("depth"), F.col("path"))
    keys = written(tops.select("path", F.when(F.col("up") != root_path, F.col("up")).alias("up"), at.alias("key")))
    while True:
        open_keys = keys.where("up is not null")
        total = open_keys.count()
        if not total:
            return keys.select("path", "key")
        sizes = open_keys.groupBy("up").agg(F.count("*").alias("n"))
        above = keys.select(F.col("path").alias("up"), F.col("up").alias("up_up"), F.col("key").alias("up_key")).join(sizes, "up")
        met = joined_hot(open_keys, above, "up", "n", total)
        longer = met.select("path", F.col("up_up").alias("up"), F.concat("up_key", "key").alias("key"))
        keys = written(keys.where("up is null").unionByName(longer))


def ends_hashed(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the nodes in which conversations of ends (conv_id, depth, a, b) end."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = np.stack([b.column(k).to_numpy() for k in (0, 1, 2)], axis=1)
            ids = b.column(3).to_pylist()
            new = np.concatenate(([True], (node[1:] != node[:-1]).any(axis=1))) if len(node) else np.zeros(0, bool)
            cuts = sorted({*np.flatnonzero(new).tolist(), *range(0, len(ids), PIECE), len(ids)})
            text = [",".join(map(str, ids[i:j])) for i, j in zip(cuts, cuts[1:])]
            at = np.array(cuts[:-1], np.int64)
            yield pa.RecordBatch.from_arrays([*[pa.array(node[at, k]) for k in (0, 1, 2)], pa.array([ids[i] for i in at], pa.int64()), pa.array(text, pa.string())], names=["depth", "a", "b", "conv_id", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None

        def out(done: list[tuple[tuple[int, int, int], str]]) -> pa.RecordBatch:
            cols = [pa.array([n[k] for n, _ in done], pa.int64()) for k in (0, 1, 2)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([s for _, s in done], pa.string())], names=["depth", "a", "b", "ends_sha256"])

        for b in batches:
            done = []
            for d, x, y, ids in zip(*(b.column(k).to_pylist() for k in (0, 1, 2)), b.column(4)):
                if node != (d, x, y):
                    if sha:
                        done.append((node, sha.hexdigest()))
                    node, sha = (d, x, y), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.as_buffer().to_pybytes())
            yield out(done)
        if sha:
            yield out([(node, sha.hexdigest())])

    name = ["depth", "a", "b"]
    joined = in_order(ends.select(*name, "conv_id"), *name, "conv_id").mapInArrow(pieces, "depth long, a long, b long, conv_id long, ids string")
    return joined.repartition(*name).sortWithinPartitions(*name, "conv_id").mapInArrow(hashes, "depth long, a long, b long, ends_sha256 string")


def trie(conversations: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, preorder of every node."""
    spark = conversations.sparkSession
    rows, every = rebuilt(counted(written(turns(conversations)), "conv_id", "turn", "x", "y"), group, heads)
    rows, every = written(rows), written(every)
    all_convs = every.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min(F.xxhash64("conv_id")).alias("path")).first()
    names = "depth long, a long, b long, up_a long, up_b long, conv_id long, n_convs long, path long, bytes long"
    top = [(0, 0, 0, None, None, all_convs.conv_id, all_convs.n_convs, all_convs.path, 0)] if all_convs.n_convs else []
    for factors in FACTORS:
        members = prefixes(rows, factors)
        found = nodes(members)
        if found is not None:
            break
    else:
        raise ValueError("prefixes clash under all factors")
    found = found.unionByName(spark.createDataFrame(top, names))
    # children, then the parent's names; the parent of a hot node's children is broadcast
    children = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    found = written(found.join(children, ["depth", "a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    total = found.count()
    parents = found.where("n_children > 0").select(F.struct("depth", "a", "b").alias("of"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("parent_path"), F.col("n_children").alias("brood"))
    below = found.where("depth > 0").withColumn("of", F.struct((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")))
    below = joined_hot(below, parents, "of", "brood", total).drop("of", "brood")
    family = written(below.unionByName(found.where("depth = 0"), allowMissingColumns=True).drop("up_a", "up_b"))
    # paths, their keys and the order
    tops = family.where("depth > 0 and path <> parent_path").select("path", F.col("parent_path").alias("up"), "depth")
    root_path = all_convs.path
    keys = path_keys(tops, root_path if root_path is not None else 0)
    keys = keys.unionByName(spark.createDataFrame([(root_path, [])] if top else [], "path long, key array<long>"))
    lengths = family.groupBy("path").agg(F.count("*").alias("path_nodes"))
    keys = written(keys.join(lengths, "path"))
    leaf = (F.col("n_children") == 0).cast("long").alias("leaf")
    saved = ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")
    of_nodes = joined_hot(family, keys, "path", "path_nodes", total)
    of_nodes = of_nodes.select(F.concat("key", F.array(2 * F.col("depth") + 1)).alias("key"), "path", F.lit(1).cast("long").alias("node"), leaf, saved, "depth", "a", "b", "conv_id", "parent_conv_id", "n_convs", "n_children")
    marks = keys.select(F.concat("key", F.array(F.lit(2**63 - 1))).alias("key"), "path", "path_nodes", *[F.lit(0).cast("long").alias(c) for c in ("node", "leaf", "saved")])
    ranked = summed(written(of_nodes.unionByName(marks, allowMissingColumns=True)), ["node", "leaf", "saved"], "key")
    stop = ranked.where("node = 0").select("path", "path_nodes", F.col("leaf_before").alias("leaf_end"), F.col("saved_before").alias("saved_end"))
    spans = joined_hot(ranked.where("node = 1").drop("path_nodes"), stop, "path", "path_nodes", total)
    # where conversations end
    last = members.groupBy("conv_id").agg(F.max(F.struct("depth", "a", "b")).alias("at"))
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("depth", "a", "b")])
    ends = keep(every.join(last, "conv_id", "left").select("conv_id", F.coalesce("at", zero).alias("at")).select("conv_id", "at.*"))
    out = spans.join(ends_hashed(ends), ["depth", "a", "b"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaf_end") - F.col("leaf_before")).alias("n_leaves"),
        (F.col("saved_end") - F.col("saved_before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
        F.col("node_before").alias("preorder"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")).drop("preorder")


OP12_SQL = """
WITH t AS (
  SELECT conv_id, turn, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS w,
         sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS h
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(w ORDER BY turn NULLS FIRST, h) AS ws FROM t GROUP BY conv_id),
H AS (
  SELECT conv_id, ws, conv_id - conv_id % 5 AS base,
         (WITH RECURSIVE crc(i, v) AS (
            SELECT 0, CAST(4294967295 AS BIGINT)
            UNION ALL
            SELECT i + 1, list_reduce([xor(v, CAST(ascii(substr(CAST(conv_id AS VARCHAR), i + 1, 1)) AS BIGINT)), 0, 0, 0, 0, 0, 0, 0, 0],
                                      lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)
            FROM crc WHERE i < length(CAST(conv_id AS VARCHAR)))
          SELECT xor(max_by(v, i), 4294967295) FROM crc) % 9 AS h
  FROM o),
c AS MATERIALIZED (
  SELECT H.conv_id, list_concat(coalesce(b.ws[1:H.h], []), H.ws[H.h + 1:]) AS ws FROM H LEFT JOIN o AS b ON b.conv_id = H.base),
p AS (SELECT conv_id, d, ws[1:d] AS path, len(ws) = d AS ends FROM (SELECT conv_id, ws, unnest(range(0, len(ws) + 1)) AS d FROM c)),
n AS MATERIALIZED (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256,
         (count(*) - 1) * coalesce(strlen(path[d].t), 0) AS saved
  FROM p GROUP BY path, d),
k AS MATERIALIZED (SELECT n.*, (SELECT count(*) FROM n AS x WHERE x.depth = n.depth + 1 AND x.path[1:n.depth] = n.path) AS n_children FROM n)
SELECT k.conv_id, k.depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children,
       s.n_leaves, s.saved_tokens, k.ends_sha256
FROM k
LEFT JOIN n AS u ON u.depth = k.depth - 1 AND u.path = k.path[1:k.depth - 1]
JOIN (SELECT a.path, a.depth, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, CAST(sum(b.saved) AS BIGINT) AS saved_tokens
      FROM k AS a JOIN k AS b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path GROUP BY a.path, a.depth) AS s
  ON s.path = k.path AND s.depth = k.depth
"""
