"""SimHash near-duplicates: fingerprints of word shingles, pigeonhole blocks, Hamming check, components.

Null and empty texts have the fingerprint zero and are linked like any other. Repeated rows and equal texts share a
fingerprint. Very long texts are hashed whole, slice by slice. Ties of ids don't matter: a component's id is its least. Extra
columns of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, components, joined_hot, keep, salted_join, trim, without, written

#: Rows of one side of a comparison tile; a key with more rows is dealt over several tiles.
TILE = 2048
#: Shingles hashed at a time, so that a very long text needs no more memory than its words.
SLICE = 1 << 16


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """SimHash of one UTF-8 text: a bit is set if it is set in over half of the shingles' XXH64."""
    tokens = text.translate(LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    first = np.concatenate(([0], ends[:-1]))[: len(tokens) - words + 1].tolist()
    last = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, len(first), SLICE):
        part = np.array([digest(joined[i:j], seed) for i, j in zip(first[k : k + SLICE], last[k : k + SLICE])], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > len(first)).tolist())


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, text_key, fp) of every row; fp is the 64-bit fingerprint as a signed long, text_key tells texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_buffer().to_pybytes(), words, seed) if t.is_valid else 0 for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))], names=["doc_id", "text_key", "fp"])
            del b
            trim()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def _blocks(n: int) -> list[tuple[int, int]]:
    """n contiguous (shift, width) fields that cover 64 bits as evenly as possible."""
    cuts = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _keys(fp: Column, bits: int, blocks: int) -> Column:
    """All block combinations that a pair within `bits` differing bits must share at least one of."""
    fields = _blocks(blocks)
    out = []
    for k, chosen in enumerate(combinations(fields, blocks - bits)):
        mask = sum(((1 << w) - 1) << s for s, w in chosen)
        mask -= (1 << 64) if mask >= 1 << 63 else 0
        out.append(F.struct(F.lit(k).alias("which"), fp.bitwiseAND(F.lit(mask)).alias("part")))
    return F.array(*out)


def _tile_links(a: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the rows of one tile that lie within `bits` of each other: all links, none listed twice."""
    left, one, two = a, [], []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= bits
            if near.any():
                found = left[near]
                left = left[~near]
                one += [x] * len(found)
                two += found.tolist()
                front += list(found)
    return one, two


def links(nodes: DataFrame, bits: int = 4, blocks: int = 7) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints `fp` exactly as all pairs within `bits` would.

    Pigeonhole: of `blocks` blocks at most `bits` can differ, so a close pair shares `blocks - bits` whole blocks. Rows
    that share a key meet in one tile. A tile gives a forest, not all pairs. A key with over TILE rows is dealt over
    pairs of chunks, so that no task gathers a hot key; every pair still meets in one of its tiles.
    """
    keyed = nodes.select("fp", F.explode(_keys(F.col("fp"), bits, blocks)).alias("k")).select("fp", F.xxhash64("k.which", "k.part").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(sizes, "key")
    chunks = F.ceil(F.col("n") / TILE).cast("int")
    met = met.withColumn("c", F.pmod(F.xxhash64(F.lit(7), "fp"), chunks).cast("int")).select(
        "key", "fp", "c", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("d")
    )
    tiles = met.select(F.xxhash64("key", F.least("c", "d"), F.greatest("c", "d")).alias("tile"), "fp")
    dealt = tiles.repartition("tile").sortWithinPartitions("tile", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_t, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def out(tile: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
            ends = np.append(starts[1:], len(tile))
            n = ends - starts
            two = starts[n == 2]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= bits]
            one, other = fp[near].tolist(), fp[near + 1].tolist()
            for i, j in zip(starts[n > 2].tolist(), ends[n > 2].tolist()):
                x, y = _tile_links(fp[i:j], bits)
                one += x
                other += y
            cols = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, other)]
            return pa.RecordBatch.from_arrays(cols, names=["a", "b"])

        for b in batches:
            tile = np.concatenate((held_t, b.column(0).to_numpy()))
            fp = np.concatenate((held_f, b.column(1).to_numpy().view(np.uint64)))
            if not len(tile):
                continue
            cut = int(np.searchsorted(tile, tile[-1]))  # the last run may go on in the next batch
            if cut:
                yield out(tile[:cut], fp[:cut])
            held_t, held_f = tile[cut:], fp[cut:]
        if len(held_t):
            yield out(held_t, held_f)

    return dealt.mapInArrow(run, "a long, b long")


def _components(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, root, component_id, n) of every node of nodes (node, rep, n), and the sum of n: component_id is the least rep
    reachable over edges.

    Only nodes with an edge take part in the joins on roots, which are salted, as one root can hold a third of them.
    """
    roots = components(edges)
    linked = keep(roots.join(nodes, "node").select("node", "root", "rep"))
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = salted_join(linked.select("node", "root"), least, "root", "node").select(F.col("node").alias("at"), "root", "component_id")
    out = nodes.join(named, F.col("node") == F.col("at"), "left")
    alone = F.col("root").isNull()
    out = keep(out.select("node", F.coalesce("root", "node").alias("root"), F.when(alone, F.col("rep")).otherwise(F.col("component_id")).alias("component_id"), "n"))
    return out, out.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4, seed: int = 42, blocks: int = 7) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id) per row. component_id: least doc_id reachable over links, null only if all its ids are null."""
    fps = keep(fingerprints(docs, words, seed))
    nodes = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    named, total = _components(nodes.withColumnRenamed("fp", "node"), links(nodes, bits, blocks))
    out = joined_hot(fps.withColumn("node", F.col("fp")), named, "node", "n", total)
    return out.select("doc_id", "text_key", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component, all columns kept: that of the least doc_id (see _least)."""
    return _least(docs, near_duplicates(docs, **options))


def _least(docs: DataFrame, named: DataFrame) -> DataFrame:
    """docs with one row of each group of named (doc_id, text_key, root): least doc_id, null ids last, ties by the text's hash.

    Of rows that agree in id and text any one stays.
    """
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")
    pairs = named.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n"))
    first = pairs.groupBy("root").agg(F.min(order).alias("first"), F.sum("n").alias("size")).where("size > 1")
    met = keep(pairs.join(first, "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))))
    return without(docs, met.where("not stays").select("doc_id", "text_key"), met.where("stays and n > 1").select("doc_id", "text_key"))


#: Near copies: words of a shingle, bits of its fingerprint, and bits that may differ. Two sets with a Jaccard similarity of
#: 0.8 differ in 15.1 % of the bits (an angle of arccos 0.889) with a deviation of 1.1 %; 0.75 means 17.2 %, 0.7 19.4 %.
COPY_WORDS, COPY_BITS, COPY_DIFFER = 5, 1024, 176
#: Their candidates: pairs with a Jaccard similarity of JOIN_FOUR / 4 or more of the shingle sets meet for certain. The share
#: is below 0.8, as the distance also takes most pairs of 0.75 to 0.8.
JOIN_FOUR = 3
#: The order of the join: shingles of at least COMMON_LEAST of about COMMON_OF sampled texts come last, the COMMON_MOST most
#: frequent ones at most. The order decides how many candidates there are, never which copies are found.
COMMON_OF, COMMON_LEAST, COMMON_MOST = 8192, 4, 1 << 16


def _mixed(h: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """One further 64-bit hash per hash and round: (len(h), len(rounds))."""
    x = (h[:, None] ^ rounds[None, :]) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _ones(rows: np.ndarray) -> np.ndarray:
    """How many of the rows of 64-bit words have each bit set, by full adders over whole words."""
    total, weight = np.zeros(rows.shape[1] * 64, np.int64), 1
    while len(rows):
        carried = []
        while len(rows) > 255:  # fewer are quicker to add up one by one, and their sums fit into a byte
            m = len(rows) // 3
            a, b, c = rows[:m], rows[m : 2 * m], rows[2 * m : 3 * m]
            x = a ^ b
            carried.append((a & b) | (c & x))
            rows = np.concatenate((x ^ c, rows[3 * m :]))
        total += weight * np.unpackbits(np.ascontiguousarray(rows).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8).astype(np.int64)
        rows, weight = np.concatenate(carried) if carried else rows[:0], weight * 2
    return total


def shingles(text: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of COPY_WORDS words of one UTF-8 text; a shorter text is one shingle."""
    hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in text.translate(LOWER).split()], np.uint64)
    words = min(COPY_WORDS, len(hashes))
    if not words:
        return hashes
    h = np.zeros(len(hashes) - words + 1, np.uint64)
    for k in range(words):
        h = (h ^ hashes[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def _wide(h: np.ndarray, n: int) -> np.ndarray:
    """n bits over shingle hashes: set where over half of them set it."""
    if not len(h):
        return np.zeros(n, bool)
    rounds = np.arange(1, -(-n // 64) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    ones = sum(_ones(_mixed(h[k : k + 4096], rounds)) for k in range(0, len(h), 4096))
    return (2 * ones > len(h))[:n]


def _prefix(h: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, rarest first: those of which a pair similar enough shares one for certain.

    Such a pair shares JOIN_FOUR / 4 of either set, so the first of the shared shingles in any order that holds for all
    sets has at most a fourth of either set before it. common: sorted hashes of common shingles, with their counts.
    """
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        h = h[np.argsort(np.where(common[at] == h, counts[at], 0), kind="stable")]
    return h[: len(h) + JOIN_FOUR * len(h) // -4 + 1]


NONE = np.empty(0, np.uint64)


def signature(text: bytes, common: np.ndarray = NONE, counts: np.ndarray = NONE) -> tuple[bytes, np.ndarray, int]:
    """Fingerprint of COPY_BITS bits of one UTF-8 text, its shingles to join by, and a hash of its whole shingle set."""
    h = shingles(text)
    return np.packbits(_wide(h, COPY_BITS)).tobytes(), _prefix(h, common, counts), xxhash.xxh64_intdigest(h.tobytes())


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that are common in a sample of the texts, and in how many of them: COMMON_MOST at most."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(1, docs.count() // COMMON_OF))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                if t.is_valid:
                    yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_buffer().to_pybytes()).view(np.int64))], names=["h"])
            trim()

    seen = some.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n"))
    top = seen.where(F.col("n") >= COMMON_LEAST).orderBy(F.desc("n"), "h").limit(COMMON_MOST).toArrow()
    h, n = top["h"].to_numpy().astype(np.int64).view(np.uint64), top["n"].to_numpy().astype(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, node, wide, parts) of every row; equal shingle sets share a node."""
    common, counts = common_shingles(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [signature(t.as_buffer().to_pybytes() if t.is_valid else b"", common, counts) for t in b.column(1)]
            wide = pa.array([w for w, _, _ in found], pa.binary())
            ends = np.cumsum([0] + [len(p) for _, p, _ in found]).astype(np.int32)
            parts = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([NONE] + [p for _, p, _ in found]).view(np.int64)))
            node = pa.array([n - (1 << 63) for _, _, n in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), node, wide, parts], names=["doc_id", "text_key", "node", "wide", "parts"])
            del b
            trim()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(run, "doc_id long, text_key long, node long, wide binary, parts array<long>")


def _forest(wide: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Row numbers of a spanning forest of the rows of one tile that lie within `most` bits of each other."""
    left, one, two = np.arange(len(wide)), [], []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(wide[left] ^ wide[x]).sum(axis=1, dtype=np.int64) <= most
            if near.any():
                found = left[near]
                left = left[~near]
                one += [x] * len(found)
                two += found.tolist()
                front += list(found)
    return one, two


def copy_links(nodes: DataFrame, most: int = COPY_DIFFER) -> DataFrame:
    """Edges (a, b) between nodes (node, wide, parts) that share a part and differ in at most `most` bits.

    All pairs of the similarity that _prefix is made for share a part. Parts with the very same nodes are tried once. A
    part with over TILE nodes is dealt over pairs of chunks; a tile gives a forest, not all pairs.
    """
    keyed = nodes.select("node", F.explode("parts").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y")).where("n > 1")
    sizes = sizes.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
    chunks = F.ceil(F.col("n") / TILE).cast("int")
    met = keyed.join(sizes, "key").withColumn("c", F.pmod(F.xxhash64(F.lit(7), "node"), chunks).cast("int")).select("key", "node", "c", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("d"))
    tiles = met.select(F.xxhash64("key", F.least("c", "d"), F.greatest("c", "d")).alias("tile"), "node")
    whole = nodes.select(F.col("node").alias("of"), "wide")
    dealt = tiles.join(whole.hint("merge"), F.col("node") == F.col("of")).select("tile", "node", "wide").repartition("tile").sortWithinPartitions("tile", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def out(part: pa.Table) -> pa.RecordBatch:
            tile, node = part["tile"].to_numpy(), part["node"].to_numpy()
            wide = np.frombuffer(b"".join(part["wide"].to_pylist()), np.uint64).reshape(len(tile), -1)
            starts = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
            one, two = [], []
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(tile)]):
                x, y = _forest(wide[i:j], most)
                one += [i + k for k in x]
                two += [i + k for k in y]
            return pa.RecordBatch.from_arrays([pa.array(node[np.array(x, np.int64)]) for x in (one, two)], names=["a", "b"])

        for b in batches:
            part = pa.Table.from_batches([b])
            part = part if held is None else pa.concat_tables([held, part])
            if not part.num_rows:
                continue
            tile = part["tile"].to_numpy()
            cut = int(np.searchsorted(tile, tile[-1]))  # the last run may go on in the next batch
            if cut:
                yield out(part[:cut])
            held = part[cut:]
        if held is not None and held.num_rows:
            yield out(held)

    return dealt.mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, root, component_id) per row: copies whose five-word shingles have a similarity of about 0.8 or more."""
    rows = written(signatures(docs))
    nodes = written(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.any_value("wide").alias("wide"), F.any_value("parts").alias("parts"), F.count("*").alias("n")))
    named, total = _components(nodes.select("node", "rep", "n"), copy_links(nodes))
    return joined_hot(rows.select("doc_id", "text_key", "node"), named, "node", "n", total).select("doc_id", "text_key", "root", "component_id")


def one_of_near(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies, all columns kept: the least doc_id (see _least).

    Null and empty texts are copies of each other. Texts of any length are taken whole. An empty table stays empty.
    """
    return _least(docs, near_copies(docs))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, fingerprint (16 lowercase hex digits), component_id."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
