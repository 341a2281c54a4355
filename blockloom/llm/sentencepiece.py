"""SentencePiece encoding and decoding as a relational lattice.

A text is a space and then itself; it is cut where no piece of the vocabulary can lie across the cut: before a run of
spaces, around line breaks and tabs, and between characters that stand side by side in no piece. The distinct segments of
the corpus are encoded once: substrings of bounded length are exploded, equi-joined to the piece table, the edges grouped
by segment, and folded with the higher-order `aggregate`.

Texts become numbers of segments, batch by batch: a batch lists its distinct segments, most frequent first, and its texts
as places in that list. Only the lists are shuffled and meet the lattice; what they find returns to the batch's bucket. A segment has one row per
batch at most, so that no segment is hot: its share of all rows is below one in a batch's distinct segments.

The fold follows the model's kind. For a unigram model it is Viterbi. A BPE model's scores are merge ranks, which Viterbi
would add up to other segmentations than the library's, so there the fold walks the edges from the best rank on and takes
an edge that joins just two symbols: one long holds the bounds between symbols. This walk is the library's greedy merging
where no merge makes a better-ranked one possible. Pieces runs the merging on every piece to find those within which one
does (a merge depends on the characters it covers alone, so what holds inside all pieces of a text holds in the text): for
the public vocabulary one, 16 spaces. Segments that hold such a piece, and those of over FOLDED characters, whose bounds
don't fit into a long, go through the same merges with a heap; with a vocabulary of many such pieces the fold merges step
by step. Characters without a piece become byte pieces.

Null and empty texts have no pieces. U+2581 is encoded as a space, as in the library; a text that holds it does not round
trip. Repeated rows are encoded each. Very long texts are cut as they are read. Extra columns are ignored; an empty table
gives an empty result. Decoding turns bytes that are no UTF-8 into U+FFFD.
"""

from __future__ import annotations

import heapq
import re
import string
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, partitions, trim

SPACE = "▁"
#: Longest segment that the fold takes: its bounds and its spans are kept in 62 and 6 bits.
FOLDED = 60
#: Bytes of text in a batch, bytes of text from which on a text is cut piece by piece, and segments looked up at a time.
BATCH, LONG, SLICE = 32 << 20, 4 << 20, 1 << 20
#: Stands for a character without a piece where ids stand otherwise.
NO_PIECE = (1 << 20) - 1
#: Unordered pieces that segments are searched for; with more of them the fold merges step by step.
FEW = 64


class Index(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = found = len(self)
        return found


class Pieces:
    """The vocabulary of a SentencePiece model: normal pieces with their scores, byte pieces, and the model's kind."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        self.names = [p.piece for p in model.pieces]
        self.normal = {p.piece: (p.score, i) for i, p in enumerate(model.pieces) if p.type == 1}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.of_byte = {i: bytes([b]) for b, i in self.bytes.items()}
        self.encoded = [p.encode() for p in self.names]
        ranks = {x: k for k, x in enumerate(sorted({-s for s, _ in self.normal.values()}))}
        #: Equal scores share a rank; 0 is the best.
        self.rank = {p: ranks[-s] for p, (s, _) in self.normal.items()}
        self.pairs = {p[k : k + 2] for p in self.normal for k in range(len(p) - 1)}
        self.control = {i for i, p in enumerate(model.pieces) if p.type in (2, 3)}
        self.merges = model.trainer_spec.model_type == 2
        self.longest = max(map(len, self.normal), default=1)
        self.breaks = "".join(c for c in "\n\t\r" if not any(c in p for p in self.normal))
        if any(SPACE in p.lstrip(SPACE) for p in self.normal):
            raise ValueError("a piece holds a space behind other characters: segments can't be cut at spaces")
        b = re.escape(self.breaks)
        # punctuation that no piece has right behind a letter: a word ends before it, which spares many distinct segments
        marks = re.escape("".join(c for c in string.punctuation if not any(y == c and x.isalpha() for x, y in self.pairs)))
        words = [rf" *+[^\W\d_]++(?=[{marks}])"] if marks else []
        self.cut = re.compile("|".join([*words, f" *[^ {b}]+", " +", *([f"[{b}]"] if b else [])]))

    @cached_property
    def unordered(self) -> list[str]:
        """Pieces within which a merge makes a better-ranked one possible: elsewhere edges can be taken by their ranks."""
        out = []
        for p in self.normal if self.merges else ():
            taken: list[tuple[float, int, int]] = []
            self.merged(p, taken)
            if any(a > b for a, b in zip(taken, taken[1:])):
                out.append(p)
        return out

    def segments(self, text: str) -> list[str]:
        """Cut a text, with the space put before it; joined they give it back."""
        return self.cut.findall(" " + text.replace(SPACE, " ")) if text else []

    def places(self, text: str, index: Index) -> np.ndarray:
        """The text's segments as places in index, which new ones are added to."""
        if len(text) <= LONG:
            return np.array(list(map(index.__getitem__, self.segments(text))), np.int32)
        return np.fromiter((index[m[0]] for m in self.cut.finditer(" " + text.replace(SPACE, " "))), np.int32)

    @cached_property
    def joins(self) -> tuple[np.ndarray, np.ndarray]:
        """Which characters stand side by side in a piece: a table for code points below 512, and sorted keys of all pairs."""
        keys = np.array(sorted(ord(a) << 21 | ord(b) for a, b in self.pairs), np.int64)
        low = np.zeros((512, 512), bool)
        for a, b in self.pairs:
            if max(a, b) < "\u0200":
                low[ord(a), ord(b)] = True
        return low, keys

    def cuts(self, text: str, starts: np.ndarray) -> np.ndarray:
        """Where segments that lie in a row, from `starts` on, are cut: at their ends and between characters that stand side by
        side in no piece."""
        low, keys = self.joins
        cut = np.ones(len(text) + 1, bool)
        last = ""
        for k in range(0, len(text), SLICE):
            code = np.frombuffer((last + text[k : k + SLICE]).replace(" ", SPACE).encode("utf-32-le"), "<u4").astype(np.int64)
            a, b = code[:-1], code[1:]
            small = (a < 512) & (b < 512)
            inner = cut[k + 1 - len(last) : k + 1 - len(last) + len(b)]
            inner[small] = ~low[a[small], b[small]]
            key = (a << 21 | b)[~small]
            inner[~small] = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] != key
            last = text[min(k + SLICE, len(text)) - 1]
        cut[starts] = True
        return np.flatnonzero(cut)

    def merged(self, segment: str, taken: list | None = None) -> list[int]:
        """Ids of one segment by merging with a heap: for segments that are too long to fold. taken: gets the merges."""
        s = segment.replace(" ", SPACE)
        n = len(s)
        left, right, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and (found := self.normal.get(s[i : end[j]])):
                heapq.heappush(heap, (-found[0], i, end[j]))

        for i in range(n):
            offer(i)
        dead = [False] * n
        while heap:
            _, i, to = heapq.heappop(heap)
            if dead[i] or right[i] >= n or end[right[i]] != to:
                continue
            if taken is not None:
                taken.append((self.rank[s[i:to]], i, to))
            j = right[i]
            dead[j], end[i], right[i] = True, to, right[j]
            if right[i] < n:
                left[right[i]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        out: list[int] = []
        i = 0
        while i < n:
            piece = s[i : end[i]]
            out += [self.normal[piece][1]] if piece in self.normal else [self.bytes[b] for b in piece.encode()]
            i = right[i]
        return out

    def decoded(self, ids: list[int]) -> str:
        """The text of a list of ids: pieces joined, byte pieces as UTF-8, the space put before the text taken off."""
        text = self.joined(ids)
        return text[1:] if text.startswith(" ") else text

    def joined(self, ids: list[int]) -> str:
        return b"".join(self.of_byte.get(i) or (b"" if i in self.control else self.encoded[i]) for i in ids).decode("utf-8", "replace").replace(SPACE, " ")

    def best_path(self, segment: str) -> list[int]:
        """Ids of one segment by Viterbi: for segments of a unigram model that are too long to fold."""
        s = segment.replace(" ", SPACE)
        unknown = self.unknown
        cost, back = [0.0] + [float("inf")] * len(s), [0] * (len(s) + 1)
        for to in range(1, len(s) + 1):
            for frm in range(max(0, to - self.longest), to):
                found = self.normal.get(s[frm:to])
                c = cost[frm] + (-found[0] if found else unknown if to == frm + 1 else float("inf"))
                if c < cost[to]:
                    cost[to], back[to] = c, frm
        cuts, at = [], len(s)
        while at:
            cuts.append((back[at], at))
            at = back[at]
        out: list[int] = []
        for a, b in reversed(cuts):
            out += [self.normal[s[a:b]][1]] if s[a:b] in self.normal else [self.bytes.get(x, 0) for x in s[a:b].encode()]
        return out

    @cached_property
    def bytes_of(self) -> tuple[np.ndarray, np.ndarray]:
        """What the pieces decode to, one after the other, and where each ends."""
        said = [self.of_byte.get(i) or (b"" if i in self.control else e.replace(SPACE.encode(), b" ")) for i, e in enumerate(self.encoded)]
        return np.frombuffer(b"".join(said), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in said])))

    @property
    def unknown(self) -> float:
        return max((-s for s, _ in self.normal.values()), default=0.0) + 10.0


def _span(start: Column, end: Column) -> Column:
    """One key for an edge's ends; positions are below 64."""
    return start * 64 + end


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _edges(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(seg, edges): the lattice of the first n characters of each segment, edges as longs by rank, start and end: rank << 32 | start << 26 | end << 20 | id.

    words are partitioned by segment already, so grouping needs no shuffle; they are sorted, so that the sort for it has
    nothing to move. Substrings are met by digest, and the digest's piece is compared.
    """
    spark = words.sparkSession
    rows = [(p, pieces.rank[p], i) for p, (_, i) in pieces.normal.items()]
    table = spark.createDataFrame(rows, "piece string, rank long, id long").select(F.xxhash64("piece").alias("digest"), "piece", "rank", "id")
    table = F.broadcast(table)  # as many rows as the vocabulary file
    at = words.sortWithinPartitions("seg").select("seg", F.translate("seg", " ", SPACE).alias("s"), "n")
    at = at.select("seg", "s", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("start"))
    at = at.select("seg", "s", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), F.col("n") - F.col("start")))).alias("many"))
    subs = at.select("seg", "start", (F.col("start") + F.col("many")).alias("end"), F.substring("s", F.col("start") + 1, F.col("many")).alias("sub"))
    same = (F.xxhash64("sub") == F.col("digest")) & F.col("piece").startswith(F.col("sub")) & F.col("sub").startswith(F.col("piece"))
    met = subs.join(table, same, "left").where("piece is not null or end = start + 1")
    edge = F.shiftleft(F.coalesce("rank", _long(0)), 32) + F.shiftleft(_span(F.col("start"), F.col("end")).cast("long"), 20) + F.coalesce("id", _long(NO_PIECE))
    return met.select("seg", edge.alias("edge")).groupBy("seg").agg(F.sort_array(F.collect_list("edge")).alias("edges"))


def _ends(edge: Column) -> tuple[Column, Column]:
    return F.shiftright(edge, 26).bitwiseAND(63).cast("int"), F.shiftright(edge, 20).bitwiseAND(63).cast("int")


def _bit(at: Column, first: int = 1) -> Column:
    return F.call_function("shiftleft", _long(first), at)


def _char_ids(start: Column, pieces: Pieces) -> Column:
    return _byte_ids(F.substring(F.translate("seg", " ", SPACE), start + 1, F.lit(1)), pieces)


def _ranked_ids(pieces: Pieces) -> Column:
    """Ids by taking edges from the best rank on. The state is a long with a bit for each bound between symbols."""

    def step(bounds: Column, edge: Column) -> Column:
        start, end = _ends(edge)
        inner = bounds.bitwiseAND(_bit(end) - _bit(start, 2))
        ends = F.call_function("shiftright", bounds, start).bitwiseAND(F.call_function("shiftright", bounds, end)).bitwiseAND(_long(1))
        return F.when((ends == 1) & (F.bit_count(inner) == 1), bounds.bitwiseXOR(inner)).otherwise(bounds)

    def ids(bounds: Column) -> Column:
        def symbol(edge: Column) -> Column:
            start, end = _ends(edge)
            return bounds.bitwiseAND(_bit(end, 2) - _bit(start)) == _bit(start) + _bit(end)

        symbols = F.array_sort(F.transform(F.filter("edges", symbol), lambda e: e.bitwiseAND(_long((1 << 32) - 1))))
        one = lambda e: e.bitwiseAND(_long(NO_PIECE)).cast("int")
        all_known = F.transform(symbols, one)
        some_unknown = F.flatten(F.transform(symbols, lambda e: F.when(one(e) == NO_PIECE, _char_ids(_ends(e)[0], pieces)).otherwise(F.array(one(e)))))
        return F.when(F.exists("edges", lambda e: one(e) == NO_PIECE), some_unknown).otherwise(all_known)

    return F.aggregate("edges", _bit(F.length("seg"), 2) - 1, step, ids)


def _byte_ids(char: Column, pieces: Pieces) -> Column:
    h = F.hex(F.encode(char, "UTF-8"))
    table = F.array(*[F.lit(pieces.bytes.get(b, 0)) for b in range(256)])
    return F.transform(F.sequence(F.lit(0), (F.length(h) / 2).cast("int") - 1), lambda k: F.element_at(table, F.conv(F.substring(h, k * 2 + 1, F.lit(2)), 16, 10).cast("int") + 1))


def _ids(bounds: Column, pieces: Pieces) -> Column:
    """Ids of the segments between bounds."""

    def one(k: Column) -> Column:
        a, b = F.element_at(bounds, k), F.element_at(bounds, k + 1)
        found = F.try_element_at("at", _span(a, b)).bitwiseAND(F.lit((1 << 20) - 1)).cast("int")
        return F.when(found.isNotNull(), F.array(found)).otherwise(_byte_ids(F.substring(F.translate("seg", " ", SPACE), a + 1, b - a), pieces))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), one))


def _merge_fold() -> Column:
    """Bounds of the symbols after all merges: each step drops the inner bound of the best pair, until there is none."""
    none = F.lit(1 << 40)

    def step(s: Column, _: Column) -> Column:
        b = s["b"]
        rank = lambda k: F.coalesce(F.shiftright(F.try_element_at("at", _span(F.element_at(b, k), F.element_at(b, k + 2))), 20), none)
        best = F.array_min(F.transform(F.sequence(F.lit(1), F.size(b) - 2), lambda k: F.struct(rank(k).alias("rank"), k.alias("k"))))
        drop = lambda m: F.when(m["rank"] < none, F.struct(F.concat(F.slice(b, F.lit(1), m["k"]), F.slice(b, m["k"] + 2, F.size(b))).alias("b"), F.lit(False).alias("done"))).otherwise(F.struct(b.alias("b"), F.lit(True).alias("done")))
        return F.when(s["done"] | (F.size(b) <= 2), s).otherwise(F.element_at(F.transform(F.array(best), drop), 1))

    start = F.struct(F.sequence(F.lit(0), F.col("n")).alias("b"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n") - 1)), start, step)["b"]


def _viterbi_fold(costs: Column, unknown: float) -> Column:
    """Bounds of the best path of a unigram lattice: a table of (cost, path) per position, filled from left to right."""
    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.array(F.lit(0)).alias("path")))

    def step(best: Column, to: Column) -> Column:
        def through(frm: Column) -> Column:
            rank = F.shiftright(F.try_element_at("at", _span(frm, to)), 20).cast("int")
            cost = F.coalesce(F.element_at(costs, rank + 1), F.when(to == frm + 1, F.lit(unknown)))
            before = F.element_at(best, frm + 1)
            return F.struct((before["cost"] + cost).alias("cost"), F.concat(before["path"], F.array(to)).alias("path"))

        ways = F.filter(F.transform(F.sequence(F.lit(0), to - 1), through), lambda w: w["cost"].isNotNull())
        return F.concat(best, F.array(F.array_min(ways)))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), F.col("n")), start, step), -1)["path"]


def encoded_segments(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(seg, ids) of distinct segments, which are partitioned by segment and stay so; ids is null where the heap is needed."""
    heaped = F.length("seg") > FOLDED
    walked = pieces.merges and len(pieces.unordered) <= FEW
    for p in pieces.unordered if walked else ():
        heaped = heaped | F.contains(F.translate("seg", " ", SPACE), F.lit(p))
    # of a segment for the heap one character goes through the lattice, so that all segments stay in one table
    lattice = _edges(words.select("seg", F.when(heaped, 1).otherwise(F.length("seg")).alias("n")), pieces)
    if walked:
        return lattice.select("seg", F.when(~heaped, _ranked_ids(pieces)).alias("ids"))
    value = lambda e: F.struct(F.shiftright(e, 20).bitwiseAND(4095).cast("int"), F.shiftleft(F.shiftright(e, 32), 20) + e.bitwiseAND(_long(NO_PIECE)))
    known = F.filter("edges", lambda e: e.bitwiseAND(_long(NO_PIECE)) != NO_PIECE)
    by_span = lattice.select("seg", F.when(~heaped, F.length("seg")).otherwise(1).alias("n"), F.map_from_entries(F.transform(known, value)).alias("at"))
    costs = F.array(*[F.lit(float(-s)) for s in sorted({s for s, _ in pieces.normal.values()}, reverse=True)]) if not pieces.merges else None
    folded = by_span.withColumn("bounds", _merge_fold() if pieces.merges else _viterbi_fold(costs, pieces.unknown))
    return folded.select("seg", F.when(~heaped, _ids(F.col("bounds"), pieces)).alias("ids"))


#: A batch: its documents (id, number of segments, whether U+2581 occurs), their segments as places, the parts that each
#: segment is cut into as places, and the distinct parts.
NUMBERED = "batch long, doc_id array<long>, words array<long>, marked array<boolean>, places binary, many binary, of binary, parts array<string>"


def _squeezed(x: np.ndarray, through: np.ndarray | None = None) -> bytes:
    """Whole numbers below 2**32 (or what they stand for in `through`), compressed byte by byte: all lowest bytes, then all
    second ones and so on."""
    out, planes = zstandard.ZstdCompressor(3).compressobj(), []
    for shift in (0, 8, 16, 24):
        for k in range(0, len(x), SLICE):
            part = x[k : k + SLICE] if through is None else through[x[k : k + SLICE]]
            planes.append(out.compress(((part >> shift) & 255).astype(np.uint8).tobytes()))
    return b"".join([*planes, out.flush()])


def _unsqueezed(data: bytes, dtype: type = np.int64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(data), np.uint8).reshape(4, -1)
    x = raw[3].astype(dtype)
    for plane in (2, 1, 0):
        x <<= 8
        x |= raw[plane]
    return x


def numbered(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """docs (doc_id, text) as rows of NUMBERED, kept in the shared folder, in buckets by batch: they needn't be shuffled to meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        marked: list[bool] = []
        rows: list[np.ndarray] = []
        index = Index()

        def out() -> pa.RecordBatch:
            words = [len(r) for r in rows]
            flat = np.concatenate(rows)
            rows.clear()
            order = np.argsort(-np.bincount(flat, minlength=len(index)), kind="stable")
            place = np.empty(len(index), np.int32)
            place[order] = np.arange(len(index), dtype=np.int32)
            places = _squeezed(flat, place)
            del flat, place
            named = list(index)
            index.clear()
            named = [named[k] for k in order.tolist()]
            starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, named), np.int64, len(named)))))
            text = "".join(named)
            del named
            cuts = pieces.cuts(text, starts)
            many = np.diff(np.searchsorted(cuts, starts))
            at = Index()
            of = np.fromiter((at[text[i:j]] for i, j in zip(cuts[:-1], cuts[1:])), np.int32, len(cuts) - 1)
            del cuts, text
            parts = pa.array(list(at), pa.string())
            at.clear()
            parts = pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts)
            cols = [[(part << 32) + count], [list(ids)], [words], [list(marked)], [places], [_squeezed(many)], [_squeezed(of)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary()]
            names = [f.split()[0] for f in NUMBERED.split(", ")]
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds)), parts], names=names)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_buffer().to_pybytes().decode("utf-8", "replace") if t.is_valid else ""
                if ids and held + len(text) > BATCH:
                    yield out()
                    ids, marked, held, count = [], [], 0, count + 1
                    trim()
                ids.append(i)
                marked.append(SPACE in text)
                rows.append(pieces.places(text, index))
                held += len(text)
            b = t = text = None  # the batch that came in goes before the one that goes out is made
        if ids:
            trim()
            yield out()
        trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return bucketed(rows.mapInArrow(run, NUMBERED), "batch")


def gathered(flat: np.ndarray, first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Runs of flat, one after the other."""
    return flat[np.arange(int(many.sum())) + np.repeat(first - (np.cumsum(many) - many), many)]


RESULT = "doc_id long, n_tokens long, ids array<int>, round_trip boolean"


#: What a batch gets of a part of the lattice's table: places of its segments, how many ids each has, and whether they decode.
FOUND = "to long, places binary, sizes binary, ids binary, bad binary"


def _bundled(looked_up: DataFrame, pieces: Pieces) -> DataFrame:
    """(to, place, seg, ids) as rows of FOUND: a task's rows, SLICE at a time, are sorted by batch and compressed.

    Null ids are found with the heap; rows are sorted by segment, so each is done once. All ids are decoded and compared.
    """
    one = pieces.merged if pieces.merges else pieces.best_path

    def completed(b: pa.RecordBatch, last: list) -> pa.Array:
        ids = b.column(3)
        if not ids.null_count:
            return ids
        values = ids.to_pylist()
        for k in np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False)).tolist():
            seg = b.column(2)[k].as_py()
            if last[0] != seg:
                last[:] = seg, one(seg)
            values[k] = last[1]
        return pa.array(values, pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last, n = [None, None], 0
        text, ends = pieces.bytes_of

        def out() -> pa.RecordBatch:
            to, place, good = (np.concatenate([h[k] for h in held]) for k in (0, 1, 2))
            column = pa.concat_arrays([h[3] for h in held])
            order = np.lexsort((place, to))
            to, place, good = to[order], place[order], good[order]
            ids = column.take(pa.array(order))
            flat, at = ids.flatten().to_numpy(), ids.offsets.to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            runs = list(zip(starts.tolist(), [*starts[1:].tolist(), len(to)]))
            cols = [
                pa.array(to[starts]),
                pa.array([_squeezed(np.diff(place[i:j], prepend=0)) for i, j in runs], pa.binary()),
                pa.array([_squeezed(np.diff(at[i : j + 1])) for i, j in runs], pa.binary()),
                pa.array([_squeezed(flat[at[i] : at[j]]) for i, j in runs], pa.binary()),
                pa.array([_squeezed(np.flatnonzero(~good[i:j])) for i, j in runs], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(cols, names=["to", "places", "sizes", "ids", "bad"])

        for b in batches:
            if not b.num_rows:
                continue
            ids = completed(b, last)
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), decodes(ids, b.column(2), text, ends), ids))
            n += b.num_rows
            if n >= SLICE:
                yield out()
                held, n = [], 0
        if n:
            yield out()
        trim()

    return looked_up.mapInArrow(run, FOUND)


def decodes(ids: pa.Array, segs: pa.Array, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the bytes of each row's ids (text between ends, by id) are those of its segment."""
    flat, at = ids.flatten().to_numpy(), ids.offsets.to_numpy() - ids.offsets[0].as_py()
    size = ends[flat + 1] - ends[flat]
    said = gathered(text, ends[flat], size)
    length = np.diff(np.concatenate(([0], np.cumsum(size)))[at])
    raw = segs.cast(pa.large_binary())
    want = pa.concat_arrays([raw])  # offsets from 0
    to = np.frombuffer(want.buffers()[1], np.int64)[want.offset : want.offset + len(want) + 1]
    data = np.frombuffer(want.buffers()[2], np.uint8) if want.buffers()[2] else np.empty(0, np.uint8)
    good = length == np.diff(to)
    if good.all():  # then both lie alike
        wrong = np.concatenate(([0], np.cumsum(said != data[to[0] : to[-1]])))
        return np.diff(wrong[to - to[0]]) == 0
    starts = np.concatenate(([0], np.cumsum(length)))
    return np.array([g and said[a:b].tobytes() == data[c:d].tobytes() for g, a, b, c, d in zip(good.tolist(), starts, starts[1:], to, to[1:])], bool)


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """RESULT per row of docs (doc_id, text): ids, and whether decoding them gives the text back."""
    pieces = Pieces(model_file)
    batches = numbered(docs, pieces)
    # both sides of the join read one and the same shuffle: the segments with their batches, by segment
    keys = batches.select("batch", F.posexplode("parts").alias("place", "seg")).repartition(partitions(docs.sparkSession), "seg")
    words = keys.groupBy("seg").agg(F.min("batch").alias("b"), F.min("place").alias("p")).where("b >= 0 and p >= 0").select("seg")
    table = encoded_segments(words, pieces)
    looked_up = _bundled(keys.join(table.hint("merge"), "seg").select(F.col("batch").alias("to"), "place", "seg", "ids"), pieces)

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        # the parts' ids one after the other as they came, and where each place's are
        place = [np.cumsum(_unsqueezed(x.as_buffer().to_pybytes())) for x in other["places"]]
        size = [_unsqueezed(x.as_buffer().to_pybytes()) for x in other["sizes"]]
        flat = np.concatenate([np.empty(0, np.int32), *[_unsqueezed(x.as_buffer().to_pybytes(), np.int32) for x in other["ids"]]])
        wrong = np.concatenate([np.empty(0, np.int64), *[p[_unsqueezed(x.as_buffer().to_pybytes())] for p, x in zip(place, other["bad"])]])
        place, size = (np.concatenate([np.empty(0, np.int64), *x]) for x in (place, size))
        start, length = np.zeros_like(place), np.zeros_like(place)
        start[place], length[place] = np.cumsum(size) - size, size
        bad = np.zeros(len(place), bool)
        bad[wrong] = True
        doc_ids: list = []
        parts, counts, same = [np.empty(0, np.int32)], [np.empty(0, np.int64)], []
        for k in range(one.num_rows):
            cell = lambda name: one[name][k].as_py()  # noqa: E731, B023
            doc_ids += cell("doc_id")
            many, of = _unsqueezed(cell("many")), _unsqueezed(cell("of"))
            # ids of whole segments, one after the other
            own = gathered(flat, start[of], length[of])
            to = np.concatenate(([0], np.cumsum(many)))
            bound = np.concatenate(([0], np.cumsum(length[of])))[to]
            first, sizes = bound[:-1], np.diff(bound)
            ill = np.diff(np.concatenate(([0], np.cumsum(bad[of])))[to]) > 0
            places = _unsqueezed(cell("places"), np.int32)
            spans = np.concatenate(([0], np.cumsum(np.array(cell("words"), np.int64))))

            def summed(x: np.ndarray, places: np.ndarray = places, spans: np.ndarray = spans) -> np.ndarray:
                """Sums of x over each document's places."""
                total = np.zeros(len(places) + 1, np.int32)
                np.cumsum(x.astype(np.int32)[places], dtype=np.int32, out=total[1:])
                return np.diff(total[spans]).astype(np.int64)

            counts.append(summed(sizes))
            same += ((summed(ill) == 0) & ~np.array(cell("marked"), bool)).tolist()
            whole, at = np.empty(int(counts[-1].sum()), np.int32), 0
            for i in range(0, len(places), SLICE):
                some = gathered(own, first[places[i : i + SLICE]], sizes[places[i : i + SLICE]])
                whole[at : at + len(some)] = some
                at += len(some)
            parts.append(whole)
            del places, own, whole
        counts = np.concatenate(counts)
        flat = parts[1] if len(parts) == 2 else np.concatenate(parts)
        ids_col = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(flat))
        trim()
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids": ids_col, "round_trip": pa.array(same, pa.bool_())})

    return batches.drop("parts").groupBy("batch").cogroup(looked_up.groupBy("to")).applyInArrow(run, RESULT)


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give the empty text, unknown ids raise."""
    pieces = Pieces(model_file)

    def run(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in ids:
            yield s.map(lambda x: pieces.decoded([] if x is None else list(x)))

    return encoded.select("doc_id", F.pandas_udf(run, "string")("ids").alias("text"))


def model_path(spark: SparkSession) -> str:
    """The vocabulary file of the contract query: blockloom.sentencepiece.model, or the installed public one."""
    found = spark.conf.get("blockloom.sentencepiece.model", None)
    if found:
        return found
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Pieces of every whole text of documents: doc_id, n_tokens, ids, round_trip."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path(spark))
