"""LM scoring by context-tree weighting over binary-decomposed bytes, and the unigram base score.

A text is its bytes, A-Z lower-cased, then an end mark (0xFF, which no UTF-8 text holds; it also fills the context before
the first byte). Each byte is eight binary choices. A node is a context of 0 to DEPTH preceding bytes and the choices made
so far; its Krichevsky-Trofimov estimate is weighted half and half with the product of its children (one more byte of
context). Counts come from all training texts. Scoring uses the trained tree as it stands, so a byte's probability
depends on its n-gram alone: every n-gram that occurs anywhere is scored once, and texts sum them.

The tree is built level by level with aggregates and joins of (node) tables that grow with the corpus; nothing of them is
broadcast or collected. Null texts are empty; very long ones are a batch of their own, and n-grams are sorted in parts. Repeated rows count and are scored each. Extra columns are ignored. With no
training text every bit costs one bit and the base score is the contract's with N = V = 0. An empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import pack, unpack
from .common import held_out, keep, partitions, trim, written

#: Bytes of context, and bytes of text whose n-grams are sorted at a time.
DEPTH = 4
CHUNK = 2 << 20
MARK = b"\xff"


def grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """n-grams (DEPTH bytes of context, then the byte) of lower-cased texts with their marks; and each text's count."""
    k = 0
    while k < len(texts):
        size, last = 0, k
        while last < len(texts) and (last == k or size + len(texts[last]) < CHUNK):
            size += len(texts[last])
            last += 1
        data = np.frombuffer(b"".join(MARK * DEPTH + t + MARK for t in texts[k:last]), np.uint8)
        n = np.array([len(t) + 1 for t in texts[k:last]], np.int64)
        key = np.zeros(len(data) - DEPTH, np.int64)
        for back in range(DEPTH, -1, -1):
            key <<= 8
            key |= data[DEPTH - back : len(data) - back]
        inside = np.ones(len(key), bool)  # not the marks before a text but the first
        starts = np.cumsum(n + DEPTH)[:-1] - DEPTH
        for e in range(DEPTH):
            inside[starts + e] = False
        yield key[inside], n
        k = last


def _counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of texts and their counts."""
    found = [np.unique(key, return_counts=True) for key, _ in grams(texts)]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return key, np.bincount(at, np.concatenate([c for _, c in found]), len(key)).astype(np.int64)


def keys(packed: DataFrame) -> DataFrame:
    """(batch, word or null, gram, n): distinct words and n-grams of each batch; n counts training texts only.

    For a word, gram is its place among the batch's sorted words, which the scoring pass finds again by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                batch, _, held, texts = unpack(b, k)
                train = [t for t, h in zip(texts, held) if not h]
                rest = [t for t, h in zip(texts, held) if h]
                words: Counter = Counter()
                for t in train:
                    words.update(t.split())
                for t in rest:
                    for w in t.split():
                        words.setdefault(w, 0)
                named = sorted(words)
                (g, n), (more, _) = _counted(train), _counted(rest)
                more = np.setdiff1d(more, g, assume_unique=True)
                n_words = len(named)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n_words + len(g) + len(more), batch)),
                        pa.concat_arrays([pa.array(named, pa.binary()), pa.nulls(len(g) + len(more), pa.binary())]),
                        pa.array(np.concatenate((np.arange(n_words), g, more))),
                        pa.array(np.concatenate((np.fromiter(map(words.__getitem__, named), np.int64, n_words), n, np.zeros(len(more), np.int64)))),
                    ],
                    names=["batch", "word", "gram", "n"],
                )
                del texts, train, rest, words, named, g, n, more
                trim()

    return packed.mapInArrow(run, "batch long, word binary, gram long, n long")


def _lgamma(x: Column) -> Column:
    """Log gamma for x >= 0.5, by Stirling's series seven places up."""
    y = x + 7.0
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    shift = x
    for k in range(1, 7):
        shift = shift * (x + k)
    return series - F.log(shift)


def _kt(n0: Column, n1: Column) -> Column:
    """Log of the Krichevsky-Trofimov block probability."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1.0) - 1.1447298858494002


def _bits(table: DataFrame, *more: str) -> DataFrame:
    """Eight rows per n-gram: its node at full depth (context, then the choices so far behind a leading 1) and the choice."""
    byte = F.col("gram").bitwiseAND(255)
    at = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.struct(
            (F.call_function("shiftleft", F.lit(1), i) + F.call_function("shiftright", byte, 8 - i)).alias("choices"),
            F.call_function("shiftright", byte, 7 - i).bitwiseAND(1).alias("bit"),
        ),
    )
    return table.select("gram", *more, F.explode(at).alias("b")).select("gram", *more, (F.shiftright("gram", 8) * 256 + F.col("b.choices")).alias("node"), F.col("b.bit").alias("bit"))


def _up(node: Column, depth: int) -> Column:
    """The node with `depth` bytes of context above a deeper node."""
    mask = (1 << (8 * depth)) - 1
    return F.shiftright(node, 8).bitwiseAND(F.lit(mask).cast("long")) * 256 + node.bitwiseAND(255)


def tree(counts: DataFrame) -> list[DataFrame]:
    """Per depth, (node, whole): the probability of choice 1 at nodes of full depth; above it, the mixture where the child is new."""
    level = _bits(counts, "n").groupBy("node").agg(F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("n1"))
    kt = _kt(F.col("n0").cast("double"), F.col("n1").cast("double"))
    levels = [keep(level.withColumn("lw", kt).withColumn("w", F.lit(1.0)))]
    for depth in range(DEPTH - 1, -1, -1):
        up = levels[0].groupBy(_up(F.col("node"), depth).alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("lw").alias("below"))
        up = up.withColumn("le", kt)
        top = F.greatest("le", "below")
        up = up.withColumn("lw", top + F.log(F.exp(F.col("le") - top) + F.exp(F.col("below") - top)) - math.log(2))
        levels.insert(0, keep(up.withColumn("w", F.exp(F.col("le") - F.col("lw") - math.log(2))).select("node", "n0", "n1", "lw", "w")))
    # top down: some = what the depths so far add to the probability of choice 1, left = the weight left for deeper ones
    one = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    mixed = []
    for depth, level in enumerate(levels):
        rows = level.select("node", one.alias("one"), "w")
        if depth:
            above = mixed[-1].select(F.col("node").alias("parent"), "some", "left")
            rows = rows.join(above, _up(F.col("node"), depth - 1) == F.col("parent"))
        else:
            rows = rows.withColumn("some", F.lit(0.0)).withColumn("left", F.lit(1.0))
        rows = rows.select("node", (F.col("some") + F.col("left") * F.col("w") * F.col("one")).alias("some"), (F.col("left") * (1 - F.col("w"))).alias("left"))
        mixed.append(keep(rows))
    return [m.select("node", (F.col("some") + F.col("left") / 2).alias("whole")) for m in mixed]


def gram_scores(all_grams: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(gram, value): log10 of the byte's probability after its context, for every n-gram, seen in training or not."""
    rows = keep(_bits(all_grams))
    nodes = rows.select("node").distinct()
    known = []
    for depth in range(DEPTH, -1, -1):
        level = levels[depth].select(F.col("node").alias(f"at_{depth}"), F.col("whole").alias(f"p_{depth}"))
        nodes = nodes.join(level, (F.col("node") if depth == DEPTH else _up(F.col("node"), depth)) == F.col(f"at_{depth}"), "left").drop(f"at_{depth}")
        known.append(f"p_{depth}")
    nodes = nodes.select(F.col("node").alias("of"), F.coalesce(*known, F.lit(0.5)).alias("one"))
    rows = rows.join(nodes, F.col("node") == F.col("of"))
    return rows.groupBy("gram").agg(F.sum(F.log10(F.when(F.col("bit") == 1, F.col("one")).otherwise(1 - F.col("one")))).alias("value"))


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


def score(docs: DataFrame, folds: int = 10) -> DataFrame:
    """RESULT per row of docs (doc_id, text)."""
    packed = pack(docs, held_out("doc_id", folds))
    found = written(keys(packed))
    # a word has one row per batch at most, so no word is hot; both sides of the join read one and the same shuffle
    words = found.where("word is not null").select("batch", "word", "gram", "n").repartition(partitions(docs.sparkSession), "word")
    counts = words.groupBy("word").agg(F.sum("n").alias("c"), F.min("batch").alias("least"), F.min("gram").alias("g")).where("least >= 0 and g >= 0").select("word", "c", "least")
    met = words.join(counts.hint("merge"), "word")
    by_word = written(met.select("batch", F.lit(True).alias("is_word"), "gram", F.col("c").cast("double").alias("value"), (F.col("batch") == F.col("least")).alias("first")))
    n_words = found.where("word is not null").select(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    v_words = by_word.select(F.count_if(F.col("first") & (F.col("value") > 0))).first()[0]
    n_end = packed.select(F.coalesce(F.sum(F.size(F.filter("flag", lambda f: ~f))), F.lit(0))).first()[0]
    total, distinct = n_words + n_end, v_words + (n_end > 0)
    below = total + 0.1 * (distinct + 1)
    seen = found.where("word is null").select("batch", "gram", "n")
    all_grams = keep(seen.groupBy("gram").agg(F.sum("n").alias("n")))
    values = keep(gram_scores(all_grams.select("gram"), tree(all_grams.where("n > 0"))))
    by_gram = seen.select("batch", "gram").join(values.hint("merge"), "gram").select("batch", F.lit(False).alias("is_word"), "gram", "value")
    looked_up = by_word.drop("first").unionByName(by_gram).withColumnRenamed("batch", "to")

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        is_word = other["is_word"].to_numpy()
        gram, value = other["gram"].to_numpy(), other["value"].to_numpy()
        count = np.zeros(int(is_word.sum()))
        count[gram[is_word]] = value[is_word]
        cost, known = np.log10((count + 0.1) / below), count > 0
        end = math.log10((n_end + 0.1) / below)
        index, value = pd.Index(gram[~is_word]), value[~is_word]
        out: dict[str, list] = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes")}
        for k in range(one.num_rows):
            _, ids, held, texts = unpack(one, k)
            out["doc_id"] += ids
            out["held_out"] += held.tolist()
            named: set[bytes] = set()
            for t in texts:
                named.update(t.split())
            place = {w: i for i, w in enumerate(sorted(named))}
            for t in texts:
                tokens = t.split()
                at = np.fromiter(map(place.__getitem__, tokens), np.int64, len(tokens))
                out["n_tokens"].append(len(tokens) + 1)
                out["n_known"].append(int(known[at].sum()) + (n_end > 0))
                out["base_score"].append(float(cost[at].sum()) + end)
                out["n_bytes"].append(len(t))
            for key, n in grams(texts):
                out["score"] += np.add.reduceat(value[index.get_indexer(key)], np.cumsum(n) - n).tolist()
        out["train_tokens"] = [total] * len(out["doc_id"])
        trim()
        kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "n_bytes": pa.int64()}
        return pa.table({k: pa.array(out[k], kind) for k, kind in kinds.items()})

    return packed.groupBy("batch").cogroup(looked_up.groupBy("to")).applyInArrow(run, RESULT)


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; and n_bytes."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
