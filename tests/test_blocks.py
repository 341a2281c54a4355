"""Files to blocks, and the column functions on their own."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.functions import features, language, normalize, segment
from blockloom.operators import control, embedding, escalation, layout, recipes, refine
from blockloom.operators.text_blocks import refine_pieces, text_blocks
from blockloom.plans.convert import convert
from blockloom.schema import quarantine
from blockloom.sources import files, payloads, sinks, structured, tables
from blockloom.sources.parsers import parse


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def blocks_of(spark, folder, **files_):
    for name, text in files_.items():
        (folder / name.replace("__", ".")).write_bytes(text if isinstance(text, bytes) else text.encode())
    return refine_pieces(parse(files.scan(spark, str(folder)))).orderBy("source", "pos").collect()


def test_mixed_text(spark, tmp_path):
    got = blocks_of(spark, tmp_path, a__txt="Subject: hello\nName -> value\n2024-01-01 10:00 went home\n- bullet\n")
    assert [b.type for b in got] == ["kv", "kv", "log", "list_item"]
    assert got[1].attrs == {"key": "Name", "value": "value"}
    assert got[2].attrs == {"timestamp": "2024-01-01 10:00", "message": "went home"}


def test_pipe_and_space_tables(spark, tmp_path):
    got = blocks_of(spark, tmp_path, a__txt="| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |\n", b__txt="name  age  city\nbob  12  new york\nal  13  rome\n")
    assert [(b.type, b.attrs["delimiter"], b.attrs["row_count"]) for b in got] == [("table", "pipe", "3"), ("table", "whitespace", "3")]
    assert json.loads(got[1].attrs["rows"])[1] == ["bob", "12", "new york"]


def test_table_rules():
    assert tables.table(["a,b", "c,d", "plain"]) == ("comma", [["a", "b"], ["c", "d"]])
    assert tables.table(["one line"]) is None
    assert tables.table(["no table", "here either"]) is None
    assert tables.table(['"x, y",1', "z,2"]) == ("comma", [["x, y", "1"], ["z", "2"]])


def test_ini(spark, tmp_path):
    got = blocks_of(spark, tmp_path, x__cfg="# c\nhost localhost\nport 80\n[service]\npath /a\nmode fast\nname => v\n")
    assert got[0].attrs["coerced_pairs"] == "5" and got[0].attrs["section_count"] == "1"
    keys = {b.attrs["key"]: b.attrs.get("value") for b in got}
    assert keys["<defaults>.host"] == "localhost" and keys["service.path"] == "/a"


def test_json_walk_and_paths():
    rows = structured.json_rows('{"a": {"b": "x", "c": [1, 2]}, "odd key": true}')
    assert [r[2]["key"] for r in rows] == ["<root>", "a", "a.b", "a.c", "a.c[0]", "a.c[1]", "odd key"]
    assert rows[4][2]["path_r"] == ".data$a$c[[1]]" and rows[6][2]["path_r"] == '.data[["odd key"]]'
    assert rows[6][2]["value"] == "true"


def test_loose_json():
    assert structured.loose_json("{'a': 1, // c\n 'b': [1, 2,],}")[1] in ("sanitized", "yaml")
    assert structured.loose_json('{"a": 1, /* c */ "b": [1,],}') == ({"a": 1, "b": [1]}, "sanitized")
    with pytest.raises(ValueError):
        structured.loose_json("")


def test_jsonl_limit_and_bad_lines():
    rows = structured.jsonl_rows("\n".join(['{"id": 1}', "bad", *['{"id": 2}'] * 300]))
    assert rows[0][2]["key"] == "record[1]" and rows[3][0] == "other"
    assert len(rows) == 400 and rows[-1][2]["truncated"] == "true"


def test_formats(spark, tmp_path):
    got = blocks_of(
        spark,
        tmp_path,
        a__md="# Head\ntext line here\n- li\n```\ncode\n```\n",
        b__html="<title>T t</title><h1>H h</h1><p>Para one.</p><ul><li>x y</li></ul><table><tr><td>1</td><td>2</td></tr></table>",
        c__eml="Subject: S\nFrom: a@b.c\nTo: d@e.f\nContent-Type: text/plain\n\nHello body text.\n",
        d__ics="BEGIN:VCALENDAR\nBEGIN:VEVENT\nSUMMARY:Meet\nDTSTART:2024\nLOCATION:Ro\n me\nEND:VEVENT\n",
        e__yaml="a: 1\nb: [x]\n",
        f__toml="a = 1\n[t]\nb = 'x'\n",
        g__docx=b"no zip",
    )
    kinds = {}
    for b in got:
        kinds.setdefault(b.source[-2:] if False else b.source.rsplit("/", 1)[1][0], []).append(b.type)
    assert kinds["a"] == ["heading", "paragraph", "list_item", "code"]
    assert kinds["b"] == ["title", "heading", "paragraph", "list_item", "table"]
    assert kinds["c"] == ["meta", "paragraph"]
    assert kinds["d"] == ["event"]
    assert kinds["e"][0] == "metadata" and kinds["f"][0] == "metadata"
    assert next(b for b in got if b.source.endswith("docx")).parse_error.startswith("BadZipFile")


def test_chunks_stay_short(spark):
    text = " ".join(f"Sentence {i} goes on and on here." for i in range(79))
    parts = one(spark, text, segment.shatter)
    assert len(parts) > 1 and all(len(p) <= 600 for p in parts) and " ".join(parts) == text
    assert [len(p) for p in one(spark, "x" * 1300, segment.shatter)] == [600, 600, 100]


def test_text_blocks_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "one\n\n\ntwo words here now then\r\n")], "doc_id long, text string").withColumn("extra", F.lit(1))
    got = [(b.doc_id, b.pos, b.type, b.text) for b in text_blocks(df).orderBy("doc_id", "pos").collect()]
    assert got == [(1, 0, "other", ""), (2, 0, "other", ""), (3, 0, "paragraph", "one"), (3, 1, "paragraph", "two words here now then")]


@pytest.mark.parametrize("text,native,python", [("1.Intro", "heading", "paragraph"), ("3.14 is pi", "heading", "paragraph"), ("1. Intro", "heading", "header"), ("ALL CAPS", "heading", "header"), ("a: b", "kv", "kv"), ("- a\n- b", "list", "list"), ("", "other", "other")])
def test_infer(spark, text, native, python):
    assert one(spark, text, lambda c: normalize.infer(F.lit("paragraph"), c)) == native
    assert one(spark, text, lambda c: normalize.infer(F.lit("paragraph"), c, "python")) == python


def test_clean(spark):
    assert one(spark, "• a  \r\n\r\n b\n\nc  ", normalize.clean) == "- a\n b\nc"
    assert one(spark, "ﬁ２", lambda c: normalize.nfkc(c)) == "fi2"


def test_language(spark):
    assert one(spark, "これは日本語の文章ですよね、はい", language.guesses)[0].lang == "ja"
    assert one(spark, "short", language.guesses) == []
    assert one(spark, None, language.guesses) == []
    row = spark.range(1).select(language.hints(F.array(F.lit(" en "), F.lit("ja")), F.array(F.lit("ja"), F.lit(""))).alias("h")).first()
    assert row.h == ["en", "ja"]


def candidates(spark, rows):
    df = spark.createDataFrame([(1, i, "paragraph", "x" * 50, c) for i, c in enumerate(rows)], "doc_id long, pos int, type string, text string, confidence double")
    return df.withColumn("attrs", F.create_map().cast("map<string,string>"))


def test_selection(spark):
    got = escalation.select(candidates(spark, [0.9, 0.5, 0.2])).where("selected").orderBy("rank").collect()
    assert [r.pos for r in got] == [2, 1]
    assert [r.pos for r in escalation.select(candidates(spark, [0.9, 0.2, 0.1]), max_confidence=0.5, limit=1).where("selected").collect()] == [2]
    assert escalation.select(candidates(spark, [0.1]), limit=0).where("selected").count() == 0


def test_escalation_attaches_and_survives_failure(spark):
    b = candidates(spark, [0.1, 0.9])
    good = escalation.escalate(b, lambda p: {"model": "m", "choices": [{"message": {"content": p}}]}).orderBy("pos").collect()
    assert good[0].llm_escalations[0].choices[0].text == "x" * 50 and good[1].llm_escalations is None

    def broken(prompt):
        raise RuntimeError("down")

    assert all(r.llm_escalations is None for r in escalation.escalate(b, broken).collect())


def test_recipes(spark):
    df = candidates(spark, [0.5]).withColumn("text", F.lit("[2024-01-02 10:00] hi"))
    row = recipes.apply_recipe(df, recipes.CALL_LOG).first()
    assert (row.type, row.confidence, row.attrs["kind"]) == ("meta", 0.9, "timestamp")
    assert recipes.apply_recipe(df.withColumn("type", F.lit("code")).withColumn("text", F.lit("zzz")), recipes.CALL_LOG).first().type == "code"
    with pytest.raises(ValueError):
        recipes.parse_recipe("name: x\nbad: 1")
    assert recipes.parse_recipe("name: x\npatterns:\n- when: '^a'\n  as: kv\n").rules[0].kind == "kv"


def test_learn_recipe(spark):
    pos = spark.createDataFrame([("ID-12", "kv"), ("ID-345", "kv")], "text string, type string")
    neg = spark.createDataFrame([("hello",)], "text string")
    rule, report = recipes.suggest(pos, neg)
    r = report.first()
    assert (r.matched, r.missed, r.false_positives, r.score) == (2, 0, 0, 1.0)
    assert recipes.parse_recipe(recipes.render_yaml("n", rule, r.score)).rules[0].when == rule.when


def test_learn_recipe_from_all_examples(spark):
    texts = [f"ID-{k}" for k in range(2000)] + ["ID-12345678", "ID-x|y", "ID:7", "ID--", "", "ID-1 a"]
    rows = [(t, "kv", {"unit": str(i), "a": "b"} if i % 2 else None) for i, t in enumerate(texts)]
    pos = spark.createDataFrame(rows, "text string, type string, attrs map<string,string>")
    for df, some in ((pos.coalesce(1), texts), (pos.repartition(7), texts), (pos.limit(2000), texts[:2000])):
        rule, report = recipes.suggest(df)
        assert rule.when == recipes.build_pattern(some) and rule.kind == "kv" and set(rule.attrs) == {"unit", "a"}
        assert report.first().matched + report.first().missed == len(some)
    ordered = recipes.suggest(pos.coalesce(1))[0]
    assert ordered.attrs["unit"] == "2005" and ordered.when != "^.*$"
    odd = ["a", "1", "-", "a1", "1-", "a|b", "x y|"] + [f"{a}|{k}" for k in range(30) for a in "a-"]
    for some in (odd, odd[:3], ["a||b", "c--d"], ["||||||"]):
        df = spark.createDataFrame([(t, "kv") for t in some], "text string, type string").coalesce(1)
        assert recipes.suggest(df)[0].when == recipes.build_pattern(some)
    with pytest.raises(ValueError):
        recipes.suggest(pos.limit(0))


def test_learnt_pattern_is_bounded(spark):
    texts = [f"{a}{k}" for k in range(400) for a in ("x", "-", "", "Q")]
    df = spark.createDataFrame([(t, "kv") for t in texts], "text string, type string").repartition(3)
    assert recipes.suggest(df)[0].when == recipes.build_pattern(texts)
    rule, report = recipes.suggest(df, most_letters=50)
    assert rule.when == r"^(?:Q|\-|\d{1,3}|x)\d{1,3}$"  # digits stand first in texts without a letter
    assert report.first().missed == 10  # 0 to 9 alone are one run, the pattern has two
    none = recipes.suggest(df, most_letters=0)[0].when
    assert none == r"^(?:[A-Z]{1,1}|[^A-Za-z0-9\s]{1,1}|[a-z]{1,1}|\d{1,3})\d{1,3}$"
    odd = spark.createDataFrame([(None, "kv"), ("", "kv")], "text string, type string")
    assert recipes.suggest(odd, most_letters=0)[0].when == "^$"


def test_refine(spark):
    b = candidates(spark, [0.3, 0.9]).withColumn("text", F.lit("IT'S  A\nTITLE"))
    got = refine.refine(b).orderBy("pos").collect()
    assert got[0].text == "It'S A Title" and got[0].ml_refine.original_confidence == 0.3 and got[0].confidence > 0.3
    assert got[1].text == "IT'S  A\nTITLE" and got[1].ml_refine is None


def test_features_of_empty(spark):
    b = candidates(spark, [0.5]).withColumn("text", F.lit(""))
    m = b.select(features.feature_map(b).alias("m")).first().m
    assert m["text_length"] == 0 and m["type=paragraph"] == 1 and "digit_ratio" not in m


def test_layout(spark):
    rows = [(1, i, 0.0, float(y), 100.0, float(y + 5), s, 0) for i, (y, s) in enumerate([(50, 0.2), (10, 0.3), (30, 0.9)])]
    df = spark.createDataFrame(rows, "doc_id long, order_hint int, a double, b double, c double, d double, score double, page int")
    df = df.withColumn("bbox", F.struct(F.col("a").alias("x0"), F.col("b").alias("y0"), F.col("c").alias("x1"), F.col("d").alias("y1")))
    got = layout.process(df).orderBy("order").collect()
    assert [r.order_hint for r in got] == [1, 2, 0] and {r.label for r in got} == {"heading"}
    assert got[0].threshold > 0.35


def test_embedding_and_search(spark):
    b = candidates(spark, [0.5]).withColumn("page", F.lit(0)).withColumn("bbox", F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>"))
    v = embedding.embed(b).first().embedding
    assert len(v) == 256 and abs(sum(x * x for x in v) - 1) < 1e-9 and embedding.embed(b).first().embedding == v
    idx = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0])], "id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.1])], "query_id long, embedding array<double>")
    got = embedding.search(idx, q, 2).orderBy("rank").collect()
    assert [r.id for r in got] == [3, 1]
    many = q.unionByName(q.withColumn("query_id", F.lit(10)))
    assert embedding.search(idx, many, 1, most_bytes=0).count() == 2


def test_search_both_ways(spark, monkeypatch):
    """Broadcast queries, and the grid beyond: equal to brute force, with ties, nulls, zero vectors and other lengths."""
    rng = np.random.default_rng(2)
    vectors = {i: rng.integers(-2, 3, 6).astype(float) for i in range(200)}
    unit = {i: v / np.linalg.norm(v) if v.any() else v for i, v in vectors.items()}
    want = sorted((q, r + 1, i, round(s, 9)) for q in range(0, 200, 20) for r, (s, i) in enumerate(sorted(((float(unit[q] @ unit[i]), i) for i in vectors), key=lambda x: (-round(x[0], 12), -x[1]))[:7]))
    rows = [(i, v.tolist()) for i, v in vectors.items()]
    idx = spark.createDataFrame(rows + [(900, None), (901, [1.0]), (None, [1.0] * 6)], "id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame([r for r in rows if r[0] % 20 == 0], "query_id long, embedding array<double>")
    for name, value in (("TILE", 16), ("SHARD", 32), ("BLOCK", 4)):
        monkeypatch.setattr(embedding, name, value)
    for most in (0, 1 << 20):
        got = sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in embedding.search(idx, q, 7, most_bytes=most).collect())
        assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(a[3] - b[3]) < 1e-8 for a, b in zip(got, want))
        assert embedding.search(idx.limit(0), q, 7, most_bytes=most).count() == 0
    # a stray query of another length changes nothing for the rest, and finds what has its length
    stray = q.select("query_id", "embedding").unionByName(q.limit(1).select(F.lit(10**6).cast("long").alias("query_id"), F.array_append("embedding", F.lit(1.0).cast(q.schema["embedding"].dataType.elementType)).alias("embedding")))
    again = sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in embedding.search(idx, stray, 7).collect() if r.query_id != 10**6)
    assert [g[:3] for g in again] == [w[:3] for w in want]
    index = embedding.add(None, idx.where("id = 3"))
    assert embedding.add(index, idx.where("id = 4")).count() == 2
    with pytest.raises(ValueError):
        embedding.add(index, idx.where("id = 901"))


def test_control(spark):
    calls = spark.createDataFrame([("k", i, float(t), ok) for i, (t, ok) in enumerate([(0, False), (1, False), (2, False), (3, False), (40, True), (41, False)])], "key string, id long, ts double, ok boolean")
    assert [r.open_after for r in control.breaker(calls).orderBy("id").collect()] == [False, False, True, True, False, False]
    out = spark.createDataFrame([("p", 360.0, 10, 5, 0)], "profile string, latency_ms double, blocks int, escalations int, truncated int")
    state = control.accumulate(out)
    assert abs(state.first().reward_sum - (0.6 * 0.9 + 0.2)) < 1e-9
    assert control.bandit_choice(state, ["p", "q"], 0.0) == "q" and control.bandit_choice(state, ["p"], 0.0) == "p"


def test_guards(spark):
    good, bad = quarantine(candidates(spark, [0.5, 1.5]))
    assert (good.count(), bad.count()) == (1, 1)


def test_payloads(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xe9 au\r\nlait")
    (tmp_path / "b.json").write_text('{"b": 1, "a": 2}')
    (tmp_path / "c.bin").write_bytes(b"\x00\x01")
    got = {r.path[-5:]: r for r in payloads.payloads(files.scan(spark, str(tmp_path))).collect()}
    assert got["a.txt"].text.endswith("\nlait") and got["a.txt"].meta["line_count"] == "2"
    assert json.loads(got[".json"[-5:] if ".json" in got else "b.json"[-5:]].meta["keys"]) == ["a", "b"]
    assert got["c.bin"].meta["length"] == "2"
    assert payloads.checksum(b"", "blake2b") != payloads.checksum(b"")


def test_convert_documents(spark, tmp_path):
    (tmp_path / "a.log").write_text("[2024-01-02 10:00] start of the call\nCaller: Bob\n- item one\n")
    blocks, docs = convert(spark, str(tmp_path), "call_log")
    assert [b.type for b in blocks.orderBy("pos").collect()] == ["meta", "header", "list"]
    d = docs.first()
    assert d.block_count == 3 and d.languages == ["en"] and d.mime_type == "text/plain"
    rows = sinks.documents(blocks, docs.drop("block_count")).collect()
    assert len(rows) == 1 and len(rows[0].blocks) == 3


def test_stream(spark, tmp_path):
    from blockloom.streaming.files import stream_convert

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Name: value\n")
    seen = []
    q = stream_convert(spark, str(tmp_path / "in"), lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [r.type for r in seen] == ["kv"]
