"""Drivers, tenants, events of calls, profiles, metrics and the command line."""

import asyncio
import io
import json
import pickle
import struct
import urllib.error
import zlib

import pytest
from pyspark.sql import functions as F

from blockloom import cli, config, drivers
from blockloom.operators import control, escalation
from blockloom.operators.visual import image_blocks
from blockloom.plans.convert import convert
from blockloom.functions import language
from blockloom.sources import files, images, office, sinks, structured


def failing(times, error, answer=b'{"ok": true}', log=None):
    """A transport that fails some times first."""
    left = [times]

    def post(url, headers, body, timeout):
        if log is not None:
            log.append((url, headers, json.loads(body)))
        if left[0] > 0:
            left[0] -= 1
            raise error
        yield from answer.splitlines(keepends=True)

    return post


def status(code):
    return urllib.error.HTTPError("u", code, "x", {}, io.BytesIO())


SET = {"api_key": "k", "model": "m", "retry_backoff_base": 0, "retry_jitter": 0}


@pytest.mark.parametrize("error,times,works", [(status(429), 2, True), (status(500), 2, True), (status(400), 1, False), (urllib.error.URLError("refused"), 2, True), (TimeoutError(), 3, False), (ConnectionResetError(), 1, True)])
def test_retries(error, times, works):
    seen = []
    d = drivers.create("openai", SET | {"transport": failing(times, error), "observe": seen.append})
    if works:
        assert d("hello") == {"ok": True} and [s["ok"] for s in seen] == [False] * times + [True]
        assert seen[-1]["request_bytes"] > 0 and seen[-1]["response_bytes"] == 12
    else:
        with pytest.raises(drivers.DriverError):
            d("hello")


def test_breaker_in_the_call_path():
    d = drivers.create("xai", SET | {"transport": failing(99, status(400)), "circuit_breaker_failures": 2})
    for _ in range(2):
        with pytest.raises(drivers.DriverError, match="HTTP Error"):
            d("x")
    with pytest.raises(drivers.DriverError, match="circuit breaker is open"):
        d("x")
    now = [0.0]
    b = drivers.Breaker(2, 30.0, 10.0, lambda: now[0])
    b.failure()
    now[0] = 11.0
    b.failure()
    assert b.allows()  # the first was too long ago
    b.failure()
    assert not b.allows()
    now[0] = 42.0
    assert b.allows()


def test_streams():
    body = b'data: {"n": 1}\n\nnonsense\ndata: {"n": 2}\n{"n": 3}\ndata: [DONE]\ndata: {"n": 4}\n'
    log = []
    d = drivers.create("anthropic", SET | {"transport": failing(1, status(503), body, log), "system_prompt": "be brief"})
    assert [e["n"] for e in d.stream("hi")] == [1, 2, 3] and d.streams
    assert log[-1][2]["stream"] is True and log[-1][2]["system"] == "be brief" and log[-1][1]["x-api-key"] == "k"

    async def all_of(d):
        return [e async for e in d.astream("hi")], await drivers.create("echo").agenerate("x")

    d = drivers.create("openai", SET | {"transport": failing(0, status(503), body)})
    got, whole = asyncio.run(all_of(d))
    assert [e["n"] for e in got] == [1, 2, 3] and whole["choices"][0]["message"]["content"] == "x"
    plain = drivers.create("echo")
    assert not plain.streams and len(list(plain.stream("x"))) == 1


def test_a_broken_stream_is_not_started_again():
    def post(url, headers, body, timeout):
        yield b'data: {"n": 1}\n'
        raise ConnectionResetError("gone")

    got = []
    with pytest.raises(drivers.DriverError, match="gone"):
        for e in drivers.create("openai", SET | {"transport": post}).stream("x"):
            got.append(e)
    assert got == [{"n": 1}]


@pytest.mark.parametrize(
    "name,settings,url,header,key",
    [
        ("openai", {}, "https://api.openai.com/v1/chat/completions", "Authorization", "Bearer k"),
        ("azure", {"endpoint": "https://e/", "deployment": "d", "api_version": "v"}, "https://e/openai/deployments/d/chat/completions?api-version=v", "api-key", "k"),
        ("vllm", {"endpoint": "http://h:1"}, "http://h:1/v1/chat/completions", "Authorization", "Bearer k"),
        ("Mistral", {}, "https://api.mistral.ai/v1/chat/completions", "Authorization", "Bearer k"),
        ("vertex", {}, "https://generativelanguage.googleapis.com/v1beta/models/m:generateContent", "x-goog-api-key", "k"),
        ("grok", {}, "https://api.x.ai/v1/chat/completions", "Authorization", "Bearer k"),
        ("aws", {}, "https://bedrock-runtime.amazonaws.com/model/m/invoke", "x-api-key", "k"),
        ("docker", {"url": "http://h:2/x"}, "http://h:2/x", "Authorization", "Bearer k"),
    ],
)
def test_vendors(name, settings, url, header, key):
    log = []
    d = drivers.create(name, SET | settings | {"transport": failing(0, None, b"{}", log), "headers": {"X-A": "1"}, "user_agent": "t"})
    d.generate("hello", {"id": 1})
    assert log[0][0] == url and log[0][1][header] == key and log[0][1]["X-A"] == "1" and log[0][1]["User-Agent"] == "t"
    if name == "vertex":
        assert log[0][2]["contents"][0]["parts"][0]["text"] == "hello"
    else:
        assert log[0][2]["messages"][-1]["content"] == "hello" and log[0][2]["metadata"] == {"id": 1}


def test_registry():
    for name, missing in (("openai", {"model": "m"}), ("azure", SET), ("vllm", {}), ("nothing", {})):
        with pytest.raises(drivers.DriverError):
            drivers.create(name, missing)
    make = lambda s: lambda prompt: {"said": prompt, **s}
    drivers.register("mine", "Also", make=make, metadata={"provider": "me"})
    drivers.register("mine", make=make)  # the same again
    with pytest.raises(drivers.DriverError):
        drivers.register("ALSO", make=lambda s: None)
    drivers.register("also", make=make, overwrite=True)
    assert drivers.metadata("MINE") == {"provider": "me"} and drivers.create("also", {"a": 1})("x") == {"said": "x", "a": 1}
    for name in ("mine", "also", "also"):
        drivers.unregister(name)
    assert "mine" not in drivers.available() and "google" in drivers.available()
    assert pickle.loads(pickle.dumps(drivers.create("openai", SET))).url.endswith("completions")


def test_tenants(tmp_path, monkeypatch):
    monkeypatch.setenv("SECRET_NAME", "s3")
    (tmp_path / "a.yaml").write_text("driver: openai\nsettings: {api_key: $SECRET_NAME, model: '${NONE:m1}', timeout: 5}")
    (tmp_path / "b.yml").write_text("settings: {x: 1}")
    t = drivers.Tenants(str(tmp_path), defaults={"timeout": 9, "max_retries": 0})
    d = t.driver({"settings": {"model": "m2"}}, "a")
    assert d is t.driver({"settings": {"model": "m2"}}, "a") and d.timeout == 5 and d.retries == 0 and d.headers["Authorization"] == "Bearer s3"
    assert dict(d.body.settings)["model"] == "m2" and dict(t.driver({}, "a").body.settings)["model"] == "m1"
    assert t.names() == ["a", "b"] and t.driver({})("x")["model"] == "echo"
    for bad in ("b", "c"):
        with pytest.raises(drivers.DriverError):
            t.driver({}, bad)


def test_deadline_and_failures(spark):
    b = spark.createDataFrame([(1, 0, "paragraph", "some text", {"layout_confidence": "0.4"}, 0.2), (2, 0, "paragraph", "other", {}, 0.2)], "doc_id long, pos int, type string, text string, attrs map<string,string>, confidence double")
    chosen = escalation.select(b, threshold=0.0)
    p = escalation.prompts(chosen)
    assert {r.error for r in escalation.call(p, drivers.create("echo"), 1.0).collect()} == {"deadline"}
    assert escalation.due((None, 0)) is None and escalation.due((500, 200), 10.0) == 10.2
    late = escalation.escalate(b, drivers.create("echo"), threshold=0.0, until=1.0)
    assert late.where("llm_escalations is not null").count() == 0
    e = escalation.selection_events(chosen, "r").orderBy("doc_id").collect()
    assert [x.event for x in e] == ["selection"] * 2 and e[0].layout_confidence == 0.4 and e[0].block_id
    none = escalation.answer_events(chosen, escalation.call(p, drivers.create("echo"), 1.0), "r").collect()
    assert {(x.event, x.reason, x.attempted_blocks) for x in none} == {("llm_failure", "deadline", 1)}


def test_profiles(spark, tmp_path):
    state = tmp_path / "s" / "state.json"
    sized = lambda n: spark.createDataFrame([(n,)], "size long")
    calls = spark.createDataFrame([("d", 10, 5)], "driver string, calls long, failures long")
    pick = lambda **k: config.auto_profile(spark, str(state), epsilon=0.0, **k).name
    assert pick(files=sized(9_000_000)) == "archival" and pick(deadline_ms=900) == "realtime" and pick(kernel_ms=200.0) == "realtime" and pick(metrics=calls) == "balanced"
    assert pick(files=sized(1)) == "balanced"  # the first one that was never tried
    rows = [(p, x, 10, 0, 0) for p, x in (("balanced", 3000.0), ("realtime", 100.0), ("archival", 3600.0))]
    config.BanditState(str(state)).record(spark, spark.createDataFrame(rows, "profile string, latency_ms double, blocks int, escalations int, truncated int"))
    assert pick() == "realtime" and pick(candidates=("nothing",)) == "balanced"
    state.write_text("no json")
    assert pick() == "balanced"


def test_stages_and_observation(spark):
    stages = control.Stages()
    with stages("read"):
        rows, seen = control.observed(spark.createDataFrame([("ab",), ("c",)], "text string"), "blocks")
        rows.count()
    assert [n for n, _ in stages.rows()] == ["read", "total"] and stages.rows()[0][1] > 0
    assert seen.get == {"rows": 2, "chars": 3}


def test_exposition(spark):
    calls = control.call_metrics(spark.createDataFrame([("d", 1.0, True, 5.0, 10, 20, None), ("d", 2.0, False, 1.0, 1, 0, "x")], cli.CALLS))
    kernels = control.kernel_stats(spark.createDataFrame([("text", 2.0, 7, True)], cli.KERNELS))
    text = sinks.exposition(calls, kernels, {"env": 'a"b'})
    assert 'blockloom_llm_calls_total{driver="d",env="a\\"b",status="success"} 1' in text and 'blockloom_llm_calls_total{driver="d",env="a\\"b",status="failure"} 1' in text
    assert 'blockloom_kernel_units_total{env="a\\"b",kernel="text"} 7' in text and text.count("# TYPE") == 8
    event = sinks.metrics_event(calls, kernels, {"env": "x"})
    got = []
    sinks.push_event(event, got.append)
    assert got[0]["extra"]["telemetry"]["drivers"][0]["calls"] == 2 and got[0]["tags"] == {"env": "x"}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "t.yaml").write_text("driver: echo")
    assert cli.main(["drivers"]) == 0 and "bedrock" in capsys.readouterr().out
    assert cli.main(["tenants", str(tmp_path)]) == 0 and cli.main(["tenants", str(tmp_path), "--tenant", "t"]) == 0
    assert cli.main(["tenants", str(tmp_path / "none")]) == 1 and cli.main(["tenants", str(tmp_path / "none"), "--quiet"]) == 0
    capsys.readouterr()
    assert cli.main(["run", "--folder", str(tmp_path), "--tenant", "t", "--prompt", "hello"]) == 0 and "hello" in capsys.readouterr().out
    monkeypatch.setattr("sys.stdin", io.StringIO(" "))
    assert cli.main(["run"]) == 2 and cli.main(["run", "--driver", "nothing", "--prompt", "x"]) == 1
    (tmp_path / "calls.json").write_text(json.dumps({"driver": "d", "ts": 1.0, "ok": True, "latency_ms": 2.0, "request_bytes": 1, "response_bytes": 1}))
    capsys.readouterr()
    assert cli.main(["metrics", str(tmp_path / "calls.json"), "--label", "a=b"]) == 0 and 'driver="d"' in capsys.readouterr().out
    assert cli.main(["metrics", str(tmp_path / "calls.json"), "--format", "sentry"]) == 1
    (tmp_path / "trials.json").write_text("\n".join(json.dumps({"kernel": "k", "setting": s, "units": u, "seconds": 1.0}) for s, u in (("a", 1.0), ("b", 3.0))))
    capsys.readouterr()
    assert cli.main(["tune", str(tmp_path / "trials.json"), "--out", str(tmp_path / "best.json")]) == 0 and json.loads((tmp_path / "best.json").read_text()) == {"k": "b"}
    capsys.readouterr()
    assert cli.main(["profile", "realtime"]) == 0 and json.loads(capsys.readouterr().out)["max_blocks"] == 200
    assert cli.main(["profile", "auto", "--deadline-ms", "10"]) == 0 and json.loads(capsys.readouterr().out)["name"] == "realtime"


def png(extra=b""):
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    tiff = b"II*\0\x08\0\0\0" + struct.pack("<H", 2) + struct.pack("<HHI4s", 0x0112, 3, 1, b"\x06\0\0\0") + struct.pack("<HHII", 0x010E, 2, 6, 38) + b"\0\0\0\0" + b"a cat\0"
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + part(b"zTXt", b"Note\0\0" + zlib.compress(b"packed")) + part(b"iTXt", b"Name\0\0\0\0\0" + "é".encode()) + part(b"eXIf", tiff) + extra


def test_images(spark):
    meta, said = images.describe(png())
    assert meta["image_size"] == "4x5" and meta["image_mode"] == "RGB" and meta["image_orientation_corrected"] == "true"
    assert [(k, t) for k, t, _ in said] == [("Note", "packed"), ("Name", "é"), ("ImageDescription", "a cat")]
    jpeg = b"\xff\xd8\xff\xfe\x00\x07hello\xff\xc0\x00\x0b\x08\x00\x02\x00\x03\x01\x00\x00\x00\xff\xda\x00\x02"
    meta, said = images.describe(jpeg)
    assert meta["image_size"] == "3x2" and meta["image_mode"] == "L" and said[0][1] == "hello"
    assert images.describe(b"GIF89a\x05\0\x06\0")[0]["image_size"] == "5x6" and images.describe(b"") == ({}, []) and images.describe(b"\x89PNG\r\n\x1a\n") == ({}, [])
    df = spark.createDataFrame([(1, "a", bytearray(png())), (2, "b", bytearray(b"x")), (3, "c", None), (4, "d", bytearray(b"y"))], "doc_id long, path string, content binary")
    words = lambda data: [(0, 1, 1, k, 0, f"w{k}", 0.0, 20.0 * k, 50.0, 20.0 * k + 15, 90.0) for k in range(500)] if data == b"y" else []
    rows = image_blocks(df, words, "en").orderBy("doc_id", "pos").collect()
    by = {d: [r for r in rows if r.doc_id == d] for d in (1, 2, 3, 4)}
    assert [r.text for r in by[1]] == ["Image summary", "é", "packed", "a cat"] or len(by[1]) == 4
    assert by[2][0].text == by[3][0].text == "Image contained no extractable text" and by[2][0].confidence == 0.35
    assert len(by[4]) == 400 and by[4][-1].text == "Truncated after 399 structured blocks" and by[4][0].text == "w0" and by[4][0].attrs["ocr_languages"] == "en"


def test_visual_conversion(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png())
    (tmp_path / "b.txt").write_text("Name: value\n")
    blocks, docs = convert(spark, str(tmp_path), visual=True)
    assert sorted(r.text for r in blocks.collect()) == ["Image summary", "Name: value", "a cat", "packed", "é"]
    assert docs.where("truncated_blocks = 0").count() == 2


def test_ini_lines():
    text, counts = structured.coerce_ini("﻿a -> 1\n  b  two words \n#x\n\n[s] \nc: 3\nd\n[x] y z\n e => f \n")
    assert text == "[<defaults>]\na = 1\n  b = two words\n#x\n\n[s] \nc: 3\nd\n[x] y z\n e = f" and counts == {"coerced_arrow_pairs": 2, "coerced_space_pairs": 1, "coerced_pairs": 3}
    assert structured.coerce_ini("[s]\nk v\n") == ("[s]\nk = v", {"coerced_space_pairs": 1, "coerced_pairs": 1})
    assert structured.coerce_ini("") == ("[<defaults>]\n", {}) or structured.coerce_ini("") == ("[<defaults>]", {})
    assert structured.coerce_ini("k[1] v\n")[0] == "[<defaults>]\nk[1] v"
    for bad in ("", " // only a remark", "{a: [}"):
        with pytest.raises(ValueError):
            structured.loose_json(bad)
    assert structured.loose_json('{"a": "x"}') == ({"a": "x"}, None) and structured.loose_json("[1,]//x")[1] == "sanitized"


def test_workbook_sheets():
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join(f'<row><c r="B{k}"><v>{k}</v></c></row>' for k in range(1, 12001)) + "</sheetData></worksheet>")
    assert len(office.xlsx(out.getvalue())[0][1]) == 10_001 and len(office.xlsx(out.getvalue(), None, active=True)[0][1]) == 12_000
    assert office.xlsx(out.getvalue())[0][0] == "sheet1" and office.xlsx(out.getvalue())[0][1][0] == ["", "1"]


def test_a_detector_of_ones_own(spark):
    def detect(text):
        if "boom" in text:
            raise ValueError
        return [("fr", 0.9), ("de", 0.05)]

    rows = [(1, 0, "bonjour tout le monde"), (2, 0, "boom boom boom boom"), (3, 0, "short"), (4, 0, None)]
    b = spark.createDataFrame(rows, "doc_id long, pos int, text string").withColumns({"attrs": F.create_map().cast("map<string,string>"), "lang": F.lit(None).cast("string")})
    guess = language.guesses_with(detect)
    got = {r.doc_id: (r.lang, list(r.language_hints)) for r in language.annotate(b, guess=guess).collect()}
    assert got == {1: ("fr", ["fr"]), 2: ("en", ["en"]), 3: (None, []), 4: (None, [])}
    assert {r.lang for r in language.votes(b, guess=guess).collect()} == {"fr", "en"}
    with pytest.raises(ImportError):
        language.langdetect_guesses()


def test_refused_paths(tmp_path):
    (tmp_path / "a").write_text("abc")
    paths = [str(tmp_path / "a"), str(tmp_path), str(tmp_path / "b")]
    assert files.refused(paths) == {paths[1]: "not a file", paths[2]: "file not found"}
    assert files.refused(paths[:1], 2) == {paths[0]: "file too large"}
