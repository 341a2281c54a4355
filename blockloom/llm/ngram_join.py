"""Exact Jaccard join of word n-gram sets by T-occurrence search, and the components of its links.

A set of n shingles shares T = ceil(0.8 n) of them at least with every partner, since the union is no smaller than n. So it
must occur T times among the inverted lists of its shingles, and n - T + 1 of them hold each partner at least once, whichever
they are. The lists are divided in that way twice:

over tasks  of each set only its n - T + 1 rarest shingles go into the distributed index, and of those only the ones that
            occur in another text at all. How many texts have a shingle is counted exactly up to truncated hashes: batches of
            texts send their distinct hashes, sorted and delta-coded (some two bytes each), to ranges of the hash space, and
            get back those that occur more than once. So a passage that many texts share makes no candidates of them, as long
            as they have enough of their own. Sets that share an indexed shingle are gathered in tiles, named by the least
            set of the list, so the many lists of one group of copies are one tile. Equal sets are one set before anything is
            joined. A tile with over CAP shingles is dealt over chunks; what its chunks leave apart is then compared chunk by
            chunk, but sets known to be connected never again.
in a tile   DivideSkip: a set's short lists are merged, counting how often each other set occurs; sets that can still reach T
            are looked up in the long lists by binary search; the overlap found so is exact. As a tile gives a spanning
            forest of its links, a set that is already connected is no longer a partner, and a group of copies costs a
            search or two, not all pairs.

Shingles are 64-bit hashes of whole word sequences, sets are told apart by 128 bits. Counts decide the order of the lists only:
any order that all sets share gives the same links.

Null texts and texts without words have an empty set and are linked with nothing. A shorter text is one shingle. Texts are
taken whole; a text beyond CAP is a chunk of its own. Repeated rows and equal sets are in one component, null ids too; a
component's id is its least doc_id, null if it has none. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import pack, unpack
from .common import components, joined_hot, keep, partitions, trim, written
from .simhash import _components, shingles

#: Links need a hundred times the intersection to be at least so many times the union.
PERCENT = 80
#: Shingles of one tile (8 MB of hashes).
CAP = 1 << 20
#: Postings that are merged without setting long lists aside, and the weight of a list's length when they are.
MERGED, MU = 4096, 0.0085
#: Hashes of one range of the counting, and further bits that a truncated hash has, so that few meet by chance.
RANGE, SPARE_BITS = 1 << 22, 8
#: Bytes of text that a shingle takes at least, on average, for sizing ranges; no result depends on it.
SHINGLE_BYTES = 5
NONE = np.empty(0, np.uint64)


def required(n: int | np.ndarray):
    """T: shingles that a set of n shares with every partner at least."""
    return -(-PERCENT * n // 100)


class Tile:
    """Inverted lists of some sets (sorted arrays of distinct hashes), and T-occurrence searches among them."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.size)))
        keys = np.concatenate(sets) if sets else NONE
        order = np.argsort(keys, kind="stable")  # sets ascend within each list
        self.postings = np.repeat(np.arange(len(sets), dtype=np.int32), self.size)[order]
        found = keys[order]
        new = np.concatenate(([True], found[1:] != found[:-1])) if len(found) else np.zeros(0, bool)
        self.first = np.flatnonzero(new)
        self.length = np.diff(np.append(self.first, len(found)))
        self.list_of = np.empty(len(found), np.int32)
        self.list_of[order] = np.cumsum(new) - 1

    def partners(self, x: int, usable: np.ndarray) -> np.ndarray:
        """Sets marked usable that are similar enough to set x."""
        n = int(self.size[x])
        need = required(n)
        lists = self.list_of[self.starts[x] : self.starts[x + 1]]
        lists = lists[self.length[lists] > 1]
        if len(lists) < need or not n:
            return np.empty(0, np.int64)
        length = self.length[lists]
        aside = 0
        if length.sum() > MERGED:
            aside = min(need - 1, int(need / (MU * np.log2(length.max()) + 1)))
            lists = lists[np.argsort(length, kind="stable")]
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        length = self.length[short]
        at = np.repeat(self.first[short] - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
        seen = np.bincount(self.postings[at], minlength=len(self.size))
        able = usable & (seen >= need - aside) & (PERCENT * n <= 100 * self.size) & (PERCENT * self.size <= 100 * n)
        able[x] = False
        found = np.flatnonzero(able)
        share = seen[found]
        for k in long.tolist() if len(found) else ():
            held = self.postings[self.first[k] : self.first[k] + self.length[k]]
            spot = np.minimum(np.searchsorted(held, found), len(held) - 1)
            share = share + (held[spot] == found)
        return found[100 * share >= PERCENT * (n + self.size[found] - share)]

    def forest(self, roots: np.ndarray | None = None) -> tuple[list[int], list[int]]:
        """Links that connect the sets as all links would. Sets of one root are connected already."""
        left = np.ones(len(self.size), bool)
        one, two = [], []
        for start in range(len(self.size)):
            if not left[start]:
                continue
            left[start], front = False, [start]
            while front and left.any():
                x = front.pop()
                if roots is not None:
                    kin = np.flatnonzero(left & (roots == roots[x]))
                    left[kin] = False
                    front += kin.tolist()
                found = self.partners(x, left)
                left[found] = False
                one += [x] * len(found)
                two += found.tolist()
                front += found.tolist()
        return one, two


def _halves(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    a, b = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64).tolist()
    return a, b


def squeezed(values: np.ndarray) -> bytes:
    """Sorted whole numbers as compressed differences: the bytes of one place side by side, as the high ones are mostly zero."""
    steps = np.diff(values, prepend=values[:1]).astype("<u4") if len(values) else np.empty(0, "<u4")
    first = int(values[0]).to_bytes(8, "little") if len(values) else b"\0" * 8
    return first + zstandard.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def spread(data: bytes) -> np.ndarray:
    steps = np.frombuffer(zstandard.decompress(data[8:]), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    return np.uint64(int.from_bytes(data[:8], "little")) + np.cumsum(steps, dtype=np.uint64)


class Ranges:
    """Truncated hashes and the ranges that they are counted in, sized by the bytes of all texts."""

    def __init__(self, text_bytes: int, parallel: int):
        n = max(1, text_bytes // SHINGLE_BYTES)
        self.range_bits = max(0, (max(parallel, -(-n // RANGE)) - 1).bit_length())
        # a range is narrower than 2^32, as differences are kept in four bytes
        self.bits = min(64, n.bit_length() + SPARE_BITS, 32 + self.range_bits)
        self.range_bits = min(self.range_bits, self.bits)

    def cut(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(64 - self.bits)

    def of(self, values: np.ndarray) -> np.ndarray:
        return (values >> np.uint64(self.bits - self.range_bits)).astype(np.int64) if self.range_bits else np.zeros(len(values), np.int64)


SETS = "batch long, idx int, doc_id long, d1 long, d2 long, n long, range long, hashes binary, counts binary"


def sets(packed: DataFrame, ranges: Ranges) -> DataFrame:
    """Rows of two kinds: (batch, idx, doc_id, d1, d2, n) of each text, and (batch, range, hashes, counts) of a batch's distinct hashes."""
    schema = pa.schema([("batch", pa.int64()), ("idx", pa.int32()), *[(c, pa.int64()) for c in ("doc_id", "d1", "d2", "n", "range")], ("hashes", pa.binary()), ("counts", pa.binary())])

    def table(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                batch, ids, _, texts = unpack(b, k)
                found = []
                names, size = [], []
                for t in texts:
                    h = shingles(t)
                    names.append(_halves(h))
                    size.append(len(h))
                    found.append(np.unique(ranges.cut(h)))
                n = len(ids)
                yield table(n, batch=[batch] * n, idx=range(n), doc_id=ids, d1=[x for x, _ in names], d2=[y for _, y in names], n=size)
                values, counts = np.unique(np.concatenate([NONE, *found]), return_counts=True)
                del found, texts
                of = ranges.of(values)
                starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.empty(0, np.int64)
                ends = [*starts[1:].tolist(), len(of)]
                hashes = [squeezed(values[i:j]) for i, j in zip(starts.tolist(), ends)]
                how = [zstandard.compress(np.minimum(counts[i:j], 255).astype(np.uint8).tobytes()) for i, j in zip(starts.tolist(), ends)]
                yield table(len(starts), batch=[batch] * len(starts), range=of[starts], hashes=hashes, counts=how)
                del values, counts
                trim()

    return packed.mapInArrow(run, SETS)


def shared(found: DataFrame) -> DataFrame:
    """(batch, hashes, counts): of each batch's hashes those that more than one text has, and how many texts (65,535 at most)."""

    def run(part: pa.Table) -> pa.Table:
        values = [spread(v) for v in part["hashes"].to_pylist()]
        counts = [np.frombuffer(zstandard.decompress(c), np.uint8) for c in part["counts"].to_pylist()]
        every, place = np.unique(np.concatenate([NONE, *values]), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([np.empty(0, np.uint8), *counts]), minlength=len(every)).astype(np.int64)
        hashes, how, at = [], [], 0
        for v in values:
            n = total[place[at : at + len(v)]]
            at += len(v)
            hashes.append(squeezed(v[n > 1]))
            how.append(zstandard.compress(np.minimum(n[n > 1], 65535).astype("<u2").tobytes()))
        return pa.table({"batch": part["batch"], "hashes": pa.array(hashes, pa.binary()), "counts": pa.array(how, pa.binary())})

    rows = found.where("range is not null").select("batch", "range", "hashes", "counts")
    return rows.groupBy("range").applyInArrow(run, "batch long, hashes binary, counts binary")


def indexed(packed: DataFrame, nodes: DataFrame, common: DataFrame, ranges: Ranges) -> DataFrame:
    """(node, key): the shingles of each set's n - T + 1 rarest that another text has, too."""

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        node, key = [], []
        known = other.filter(pa.compute.is_valid(other["hashes"]))
        values = np.concatenate([NONE, *[spread(v) for v in known["hashes"].to_pylist()]])
        counts = np.concatenate([np.empty(0, "<u2"), *[np.frombuffer(zstandard.decompress(c), "<u2") for c in known["counts"].to_pylist()]])
        order = np.argsort(values)
        values, counts = values[order], counts[order]
        wanted = other.filter(pa.compute.is_valid(other["node"]))
        for k in range(one.num_rows):
            texts = unpack(one, k)[3]
            for n, i in zip(wanted["node"].to_pylist(), wanted["idx"].to_pylist()):
                h = shingles(texts[i])
                cut = ranges.cut(h)
                at = np.minimum(np.searchsorted(values, cut), max(0, len(values) - 1))
                met = values[at] == cut if len(values) else np.zeros(len(h), bool)
                most = len(h) - required(len(h)) + 1 - int((~met).sum())
                if most > 0:
                    kept = h[met][np.argsort(counts[at[met]], kind="stable")][:most]
                    node.append(np.full(len(kept), n, np.int64))
                    key.append(kept)
        trim()
        return pa.table({"node": pa.array(np.concatenate([np.empty(0, np.int64), *node])), "key": pa.array(np.concatenate([NONE, *key]).view(np.int64))})

    named = nodes.select("batch", "idx", "node")
    told = common.unionByName(named, allowMissingColumns=True).withColumnRenamed("batch", "to")
    return packed.groupBy("batch").cogroup(told.groupBy("to")).applyInArrow(run, "node long, key long")


def members(keyed: DataFrame) -> DataFrame:
    """(lead, node): the sets of every list with two or more of them, under the least set of the list."""
    lists = keyed.groupBy("key").agg(F.count("*").alias("held"), F.min("node").alias("lead"), F.max("node").alias("most")).where("held > 1")
    lists = written(lists)
    two = lists.where("held = 2").select("lead", F.explode(F.array("lead", "most")).alias("node"))
    more = lists.where("held > 2").select("key", "lead", "held")
    total = more.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    met = joined_hot(keyed, more, "key", "held", total).where("lead is not null").select("lead", "node")
    return written(two.unionByName(met).distinct())


def whole_sets(packed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set) of wanted (batch, idx, node): the sorted hashes of each set."""

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        nodes, out = other["node"].to_pylist(), []
        for k in range(min(1, other.num_rows) and one.num_rows):
            texts = unpack(one, k)[3]
            out = [shingles(texts[i]).tobytes() for i in other["idx"].to_pylist()]
        trim()
        return pa.table({"node": pa.array(nodes, pa.int64()), "set": pa.array(out, pa.binary())})

    return written(packed.groupBy("batch").cogroup(wanted.select(F.col("batch").alias("to"), "idx", "node").groupBy("to")).applyInArrow(run, "node long, set binary"))


def tile_links(tiles: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) within tiles (tile, node, root); root: sets of one root are connected already, null: not known."""
    dealt = tiles.join(found.hint("merge"), "node").select("tile", "node", "root", "set").repartition("tile").sortWithinPartitions("tile", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, nodes, roots, held = None, [], [], []

        def out() -> pa.RecordBatch:
            one, two = [], []
            if len(nodes) > 1:
                known = None if roots[0] is None else np.array(roots, np.int64)
                one, two = Tile(held).forest(known)
            return pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in side], pa.int64()) for side in (one, two)], names=["a", "b"])

        for b in batches:
            for t, node, root, s in zip(*(b.column(k).to_pylist() for k in (0, 1, 2)), b.column(3)):
                if t != tile:
                    yield out()
                    tile, nodes, roots, held = t, [], [], []
                nodes.append(node)
                roots.append(root)
                held.append(np.frombuffer(s.as_buffer().to_pybytes(), np.uint64))
            trim()
        yield out()

    return dealt.mapInArrow(run, "a long, b long")


def links(groups: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) that connect sets as all links between sets of one lead would. groups: (lead, node, n)."""
    sizes = groups.groupBy("lead").agg(F.ceil(F.sum("n") / CAP).alias("chunks"))
    groups = keep(groups.join(sizes, "lead"))
    at = F.pmod(F.xxhash64(F.lit(13), "node"), F.col("chunks"))
    unknown = F.lit(None).cast("long").alias("root")
    near = tile_links(groups.select(F.xxhash64("lead", at).alias("tile"), "node", unknown), found)
    wide = groups.where("chunks > 1")
    if wide.isEmpty():
        return near
    # what the chunks of a large tile have left apart: everything outside of its largest component meets all of it
    near = keep(near)
    wide = keep(wide.join(components(near), "node", "left").withColumn("root", F.coalesce("root", "node")))
    parts = wide.groupBy("lead", "root").agg(F.count("*").alias("held"))
    most = parts.groupBy("lead").agg(F.max(F.struct("held", "root")).root.alias("largest"), F.count("*").alias("parts")).where("parts > 1")
    wide = wide.join(most, "lead")
    rest = wide.where("root <> largest")
    blocks = rest.groupBy("lead").agg(F.ceil(F.sum("n") / CAP).alias("blocks"))
    block = F.pmod(F.xxhash64(F.lit(17), "node"), F.col("blocks"))
    every = wide.join(blocks, "lead").select("lead", "node", "root", at.alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("r"))
    others = rest.join(blocks, "lead").select("lead", "node", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("c"), block.alias("r"))
    tiles = every.unionByName(others).select(F.xxhash64(F.lit(1), "lead", "c", "r").alias("tile"), "node", "root").distinct()
    return near.unionByName(tile_links(tiles, found))


def similar(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs (doc_id, text)."""
    packed = pack(docs.select("doc_id", "text"), F.lit(False))
    text_bytes = packed.select(F.coalesce(F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda a, n: a + n)), F.lit(0))).first()[0]
    ranges = Ranges(text_bytes, partitions(docs.sparkSession))
    found = written(sets(packed, ranges))
    rows = found.where("range is null").select("batch", "idx", "doc_id", F.struct("d1", "d2").alias("name"), "n")
    nodes = rows.where("n > 0").groupBy("name").agg(F.min(F.struct("batch", "idx")).alias("of"), F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "name", "of.*", "rep", "copies", "n"))
    groups = members(written(indexed(packed, nodes, shared(found), ranges)))
    wanted = groups.select("node").distinct().join(nodes, "node").select("node", "batch", "idx")
    edges = links(groups.join(nodes.select("node", "n"), "node"), whole_sets(packed, wanted))
    named, total = _components(nodes.select("node", "rep", F.col("copies").alias("n")), edges)
    by = nodes.select("node", "name", "copies").join(named.select("node", "component_id"), "node").drop("node")
    out = joined_hot(rows.where("n > 0").select("doc_id", "n", "name"), by, "name", "copies", total)
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, n_shingles, component_id."""
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g
  FROM w),
x AS MATERIALIZED (SELECT r, len(g) AS n, unnest(g) AS k FROM s),
l AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM x AS a JOIN x AS b ON a.k = b.k AND a.r <> b.r AND 80 * a.n <= 100 * b.n AND 80 * b.n <= 100 * a.n
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(r, b) AS (SELECT r, r FROM s UNION SELECT reach.r, l.b FROM reach JOIN l ON l.a = reach.b)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT reach.r, min(m.doc_id) AS component_id FROM reach JOIN s AS m ON m.r = reach.b GROUP BY reach.r) AS c ON c.r = s.r
"""
