"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

One pass turns every whole text into a short vector. Class means and covariances come from sums over all labelled
training rows; each covariance is shrunk towards the pooled one and towards its own diagonal, and its Cholesky factor is
computed once on the driver (its size is the number of statistics, not of documents). The score is the logistic of the
Mahalanobis log-density difference plus the log prior odds.

Null and empty texts give the vector of an empty text and are scored like any other. Labels with null ids or quality
are ignored; repeated labels count as often as they occur. With no rows of one class the score is the smoothed prior
(1/2 without any label). Texts are taken whole, however long; equal texts score alike. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, keep, trim

NAMES = ("log_bytes", "log_words", "word_length", "word_spread", "distinct", "top_word", "upper", "digits", "stops", "symbols", "beyond_ascii", "lines", "repeated_lines", "tailed", "caps_words", "bars")

_KIND = np.zeros(256, np.int64)  # 0 other symbols, then: 1 lower, 2 upper, 3 digits, 4 space, 5 newline, 6 stops, 7 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 7
_KIND[[32, 9, 11, 12, 13]], _KIND[10], _KIND[[44, 46]] = 4, 5, 6
_SYMBOLS = frozenset(b"!#$%&*|@^~+=<>{}[]\\/_")


def _soft(x: float, at: float) -> float:
    """A share, stretched near 0 and saturated beyond `at`, so that a stray symbol is no outlier."""
    return x / (x + at)


def statistics(text: bytes) -> list[float]:
    """The vector of one UTF-8 text, over all of it."""
    n = len(text)
    kinds = np.bincount(_KIND, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=8) if n else np.zeros(8)
    words = text.split()
    w = len(words)
    lengths = np.fromiter(map(len, words), np.float64, w)
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x]
    tailed = sum(c for x, c in seen.items() if x[-1] in _SYMBOLS)
    caps = sum(c for x, c in seen.items() if x.isupper() and len(x) > 3)
    letters = kinds[1] + kinds[2]
    return [
        np.log1p(n),
        np.log1p(w),
        float(np.log1p(lengths.mean())) if w else 0.0,
        float(np.log1p(lengths.std())) if w else 0.0,
        float(np.log1p(len(seen)) / np.log1p(w)) if w else 1.0,
        _soft((max(seen.values()) - 1) / w, 0.1) if w else 0.0,
        _soft(kinds[2] / letters, 0.2) if letters else 0.0,
        _soft(kinds[3] / n, 0.1) if n else 0.0,
        _soft(kinds[6] / n, 0.05) if n else 0.0,
        _soft(kinds[0] / n, 0.1) if n else 0.0,
        _soft(kinds[7] / n, 0.1) if n else 0.0,
        _soft(len(lines) / w, 0.1) if w else 0.0,
        _soft(1 - len(set(lines)) / len(lines), 0.5) if lines else 0.0,
        _soft(tailed / w, 0.2) if w else 0.0,
        _soft(caps / w, 0.2) if w else 0.0,
        _soft(seen[b"|"] / w, 0.2) if w else 0.0,
    ]


def vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])
            del b, x
            trim()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Per class: mean, inverse Cholesky factor of the covariance, log determinant; and the log prior odds."""

    odds: float
    mean: dict[int, np.ndarray] = field(default_factory=dict)
    factor: dict[int, np.ndarray] = field(default_factory=dict)
    logdet: dict[int, float] = field(default_factory=dict)

    @classmethod
    def of_sums(cls, n: dict[int, float], sums: dict[int, np.ndarray], squares: dict[int, np.ndarray], pooled: float, diagonal: float) -> Discriminant:
        n0, n1 = n.get(0, 0), n.get(1, 0)
        out = cls(float(np.log((n1 + 1) / (n0 + 1))))
        if not n0 or not n1:
            return out
        mean = {c: sums[c] / n[c] for c in (0, 1)}
        scatter = {c: squares[c] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)}
        both = (n0 * scatter[0] + n1 * scatter[1]) / (n0 + n1)
        for c in (0, 1):
            s = (1 - pooled) * scatter[c] + pooled * both
            s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + 1e-6 * np.eye(len(s))
            chol = np.linalg.cholesky(s)
            out.mean[c], out.factor[c] = mean[c], np.linalg.inv(chol)
            out.logdet[c] = 2 * float(np.log(np.diag(chol)).sum())
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.odds)
        if self.mean:
            d = {c: (((x - self.mean[c]) @ self.factor[c].T) ** 2).sum(axis=1) + self.logdet[c] for c in (0, 1)}
            z = z + (d[0] - d[1]) / 2
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(points: DataFrame, labels: DataFrame, folds: int = 5, pooled: float = 0.15, diagonal: float = 0.1) -> Discriminant:
    """Learn from the rows of points (doc_id, x) whose label is known and that are not held out. All of them count."""
    d = len(NAMES)
    known = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("of"), F.col("quality").cast("int").alias("cls"))
    rows = points.where(~held_out("doc_id", folds)).join(known, F.col("doc_id") == F.col("of")).select("cls", "x")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((2, 1 + d + d * d))
        for b in batches:
            if not b.num_rows:
                continue
            y, x = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, d)
            for c in (0, 1):
                p = x[y == c]
                acc[c] += np.concatenate(([len(p)], p.sum(axis=0), (p.T @ p).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(acc), pa.list_(pa.float64()))], names=["cls", "sums"])

    parts = rows.mapInArrow(partial, "cls int, sums array<double>").select("cls", F.posexplode("sums").alias("k", "v"))
    found = parts.groupBy("cls", "k").agg(F.sum("v").alias("v")).collect()  # 2 * (1 + d + d * d) numbers
    acc = np.zeros((2, 1 + d + d * d))
    for r in found:
        acc[r.cls, r.k] = r.v
    cut = {c: (acc[c, 0], acc[c, 1 : 1 + d], acc[c, 1 + d :].reshape(d, d)) for c in (0, 1)}
    return Discriminant.of_sums(*({c: cut[c][k] for c in (0, 1)} for k in range(3)), pooled, diagonal)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    points = keep(vectors(docs))
    model = fit(points, labels, folds)
    d = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(b.column(1).flatten().to_numpy().reshape(-1, d))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    out = points.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id", folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """docs without those that score below the threshold, all columns kept. Texts are read twice and never shuffled.

    Null, empty and very long texts are scored like any other; rows with equal texts fare alike, whatever their ids. With no
    label of one class the score is the prior. An empty table stays empty.
    """
    model = fit(keep(vectors(docs)), labels, folds)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(place)]
            if x:
                yield b.filter(pa.array(model.score(np.array(x)) >= threshold))
            del b, x
            trim()

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, held_out, score, predicted over all documents."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
