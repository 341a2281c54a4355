"""Layout recalibration against a walk that analyses every batch again and again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.operators import layout

BOXES = "doc_id long, page int, order_hint int, score double, bbox struct<x0:double,y0:double,x1:double,y1:double>"


def conf(t, w0, h0, score):
    area, w, h = max(w0, 0.0) * max(h0, 0.0), max(w0, 0.001), max(h0, 0.001)
    name = "heading" if area < t * 0.25 or h < 10 else "table" if w / h > 3 and h > 20 else "figure" if area > t * 4 else "paragraph"
    extra = {"heading": 0.05, "table": 0.1, "figure": -0.05, "paragraph": 0.0}[name]
    return min(max(t * 0.35 + min(max(score, 0.0), 1.0) * 0.5 + min(max(w / (h + 0.001), 0.0), 6.0) * 0.03 + extra, 0.01), 0.99)


def walk(batches, t, low):
    out = []
    for boxes in batches:
        scores = [b[2] for b in boxes]
        mean, least = sum(scores) / len(scores), min(scores)
        while any(conf(t, *b) < low for b in boxes):
            up = min(max((mean * 0.6 + least * 0.4 if least < t else mean * 0.75 + t * 0.25) + 0.05, layout.LEAST), layout.MOST)
            if not up > t + 1e-3:
                break
            t = up
        out.append(t)
    return out


def boxes(r, n):
    w = np.where(r.random(n) < 0.5, r.integers(0, 400, n), r.random(n))
    h = np.where(r.random(n) < 0.5, r.integers(0, 60, n), r.random(n))
    return w.astype(float), h.astype(float), r.integers(-20, 110, n) / 100


@pytest.mark.parametrize("low", [0.0, 0.3, 0.6, 0.8, 1.0])
def test_edges_are_exact(low):
    r = np.random.default_rng(int(low * 10))
    for _ in range(60):
        w, h, s = boxes(r, int(r.integers(1, 7)))
        edges = layout.united([x for lo, hi in layout.unsure_spans(w, h, s, low) for x in zip(lo.tolist(), hi.tolist())])
        near = [x for e in edges if np.isfinite(e) for x in (e, np.nextafter(e, 9), np.nextafter(e, -9))]
        for t in [*near, *r.random(30).tolist(), 0.35, 0.95]:
            if t > 1e-4:
                assert (np.searchsorted(edges, t, "right") % 2 == 1) == any(conf(t, *b) < low for b in zip(w, h, s)), t


def test_process(spark):
    r = np.random.default_rng(3)
    rows, want = [], {}
    for doc, n in [(1, 700), (2, 5), (3, 32), (4, 33)]:
        w, h, s = boxes(r, n)
        rows += [(doc, 0, k, float(s[k]), (0.0, 0.0, float(w[k]), float(h[k]))) for k in range(n)]
        every = list(zip(w.tolist(), h.tolist(), s.tolist()))
        want[doc] = walk([every[k : k + 32] for k in range(0, n, 32)], layout.START, layout.LOW)
    got: dict = {}
    for x in layout.process(spark.createDataFrame(rows, BOXES)).select("doc_id", "batch", "threshold").distinct().orderBy("doc_id", "batch").collect():
        got.setdefault(x.doc_id, []).append(x.threshold)
    assert got.keys() == want.keys()
    assert all(np.allclose(got[d], want[d], atol=1e-12) for d in want)
    assert layout.process(spark.createDataFrame([], BOXES)).count() == 0


def test_one_large_document(spark):
    """A document of 300,000 boxes: no row of the plan holds more than one batch of them."""
    n = 300_000
    k = F.col("id")
    df = spark.range(n).select("id", F.lit(7).cast("long").alias("doc_id"), (k / 500).cast("int").alias("page"), k.cast("int").alias("order_hint"), ((k * 7919 % 100) / 100).alias("score"))
    df = df.withColumn("bbox", F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (k * 31 % 400).cast("double").alias("x1"), (k * 17 % 60).cast("double").alias("y1"))).drop("id")
    got = layout.process(df, section="page").agg(F.count("*"), F.countDistinct("batch")).first()
    assert got[0] == n and got[1] == 600 * 16
