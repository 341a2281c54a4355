"""Language profiles against brute force and held-out texts; the event log against killed and repeated batches."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from blockloom.operators import langid
from blockloom.sources import event_log

DIR = "/root/testdata/sf0.01"


def cut(text, n=3):
    t = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip()
    s = f" {t} "
    return [s[k : k + n] for k in range(len(s) - n + 1)] if t else []


def test_profiles_equal_brute_force(spark):
    texts = [("en", "the cat sat on the mat"), ("en", "that is the thing 123"), ("de", "der Hund und die Katze"), ("de", None), (None, "niemand weiss"), ("fr", "le chat est là-bas, où êtes-vous"), ("fr", "...")]
    docs = spark.createDataFrame([(k, t, lang, 1.0, "x") for k, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string, w double, gram string")
    counts = {x: Counter() for x in ("de", "en", "fr")}
    for lang, t in texts:
        if lang:
            counts[lang].update(cut(t))
    kept = {x: dict(sorted(c.items(), key=lambda kv: (-kv[1], kv[0]))[:12]) for x, c in counts.items()}
    v = len({g for k in kept.values() for g in k})
    got = {r.doc_id: r for r in langid.identify(docs, langid.learn(docs, size=12)).collect()}
    assert set(got[0].asDict()) == {"doc_id", "text", "lang", "w", "gram", "guesses"}
    for k, (_, t) in enumerate(texts):
        score = {x: sum(math.log10((kept[x].get(g, 0) + 0.5) / (counts[x].total() + 0.5 * v)) for g in cut(t)) for x in kept}
        best = max(score.values())
        share = {x: 10 ** (s - best) / sum(10 ** (y - best) for y in score.values()) for x, s in score.items()}
        want = sorted(((-p, x) for x, p in share.items() if p >= 0.12))[:3] if cut(t) else []
        assert [(g.lang, round(g.prob, 9)) for g in got[k].guesses] == [(x, round(-p, 9)) for p, x in want]
    none = langid.learn(docs.limit(0))
    assert none.langs == [] and all(r.guesses == [] for r in langid.identify(docs, none).collect())
    assert langid.identify(docs.limit(0), langid.learn(docs)).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("length(text) >= 100 and lang is not null")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = langid.identify(docs.where(held).select("doc_id", "text", "lang"), langid.learn(docs.where(~held)))
    right = found.agg(F.avg((F.get("guesses", F.lit(0))["lang"] == F.col("lang")).cast("double"))).first()[0]
    assert right >= 0.95, right


def test_event_log(spark, tmp_path):
    path = str(tmp_path / "log")
    events = spark.createDataFrame([(1, "p", "ok", 5), (1, "p", "ok", 6), (2, None, "ok", 7)], "doc_id long, prompt string, event string, n int")
    assert event_log.committed(spark, path) == []
    with pytest.raises(ValueError):
        event_log.read(spark, path)
    assert event_log.append(events, path, "a/1") and not event_log.append(events, path, "a/1")
    assert event_log.append(events.limit(0), path, "b")
    event_log.append(events, path, "c")
    event_log.uncommit(spark, path, "c")  # as a job leaves it that was killed before its commit
    assert event_log.committed(spark, path) == ["a/1", "b"]
    assert event_log.read(spark, path).count() == 3
    more = events.unionByName(spark.createDataFrame([(3, "q", "ok", 8)], events.schema))
    assert event_log.append(more, path, "c")
    assert sorted((r.batch, r.n) for r in event_log.read(spark, path).collect()) == [("a/1", 5), ("a/1", 6), ("a/1", 7), ("c", 8)]
    each = event_log.sink(path)
    each(more, 4), each(more, 4)
    assert len(event_log.committed(spark, path)) == 4


def test_stream_restart_adds_nothing_twice(spark, tmp_path):
    src, path = tmp_path / "src", str(tmp_path / "log")
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("doc_id"), F.lit("p").alias("prompt"), F.lit("ok").alias("event"))
    rows(0, 5).write.mode("append").parquet(str(src))

    def run(checkpoint):
        q = spark.readStream.schema(rows(0, 1).schema).parquet(str(src)).writeStream.foreachBatch(event_log.sink(path)).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination(60)

    run("c1")
    run("c2")  # a checkpoint that was lost: the same batch comes again
    assert event_log.read(spark, path).count() == 5
    rows(5, 8).write.mode("append").parquet(str(src))
    run("c1")
    assert event_log.read(spark, path).count() == 8
