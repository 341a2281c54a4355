"""Planned sources and line formats that are cut by byte ranges, against the parsers that read whole files."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, Not, StringContains
from pyspark.sql.types import _parse_datatype_string

from blockloom.sources import datasource, files, lines, parsers, payloads, structured


def shout(data):
    yield "block", "other", data.decode().upper(), {}, 0.5, None


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    given = {"a.md": b"# Head\n\ntext", "b.csv": b"x,y\n1,2\n", "sub/c.json": b'{"k": [1, null]}', "sub/d.txt": "Zeile ü".encode(), "sub/e.csv": b"%PDF-1.4 not a table", "f.bin": b"\0\1", "g.json": b"{broken", "h.log": b"loud", "i.md": b""}
    for name, data in given.items():
        p = root / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data)
    with open(root / "huge.csv", "wb") as f:
        f.truncate(3 << 30)
    return str(root)


def test_planned_scan_equals_scan(spark, folder):
    cols = ["path", "size", "type", "mime", "doc_id", "error", F.sha2("content", 256).alias("h")]
    want = {r.path.removeprefix("file:"): r for r in files.scan(spark, folder).select(*cols).collect()}
    got = {r.path: r for r in datasource.planned_scan(spark, folder).select(*cols).collect()}
    assert set(want) <= set(got)  # Spark's own scan leaves out empty files
    for p, r in want.items():
        assert (got[p].size, got[p].type, got[p].mime, got[p].h) == (r.size, r.type, r.mime, r.h)
    assert got[f"{folder}/huge.csv"].error == "file too large" and got[f"{folder}/huge.csv"].h is None
    assert got[f"{folder}/sub/e.csv"].type == "pdf"


def opened(reader, monkeypatch):
    seen = []
    real = datasource.FileReader.opened
    monkeypatch.setattr(datasource.FileReader, "opened", lambda self, path, size=None: seen.append((os.path.basename(path), size)) or real(self, path, size))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    return sorted(os.path.basename(r["path"]) for r in rows), seen


def reader(folder, schema=datasource.FILES, **options):
    return datasource.FileReader({"path": folder, **{k.lower(): str(v) for k, v in options.items()}}, _parse_datatype_string(schema))


def test_refused_files_are_never_opened(spark, folder, monkeypatch):
    r = reader(folder)
    left = list(r.pushFilters([In(("type",), ("csv", "json")), LessThanOrEqual(("size",), 1000), EqualTo(("error",), "x")]))
    assert left == [EqualTo(("error",), "x")]
    rows, seen = opened(r, monkeypatch)
    assert rows == ["b.csv", "c.json", "g.json"]
    assert {n for n, _ in seen} == {"b.csv", "c.json", "g.json", "e.csv"} and ("e.csv", None) not in seen
    r = reader(folder, "path string, size bigint")
    assert not list(r.pushFilters([GreaterThan(("size",), 4), Not(StringContains(("path",), "sub"))]))
    rows, seen = opened(r, monkeypatch)
    assert rows == ["a.md", "b.csv", "g.json", "huge.csv"] + [] or "huge.csv" in rows
    assert seen == []
    r = reader(folder, glob="*.md", ignore="*i.md")
    assert opened(r, monkeypatch)[0] == ["a.md"]
    assert reader(folder, maxBytes=2).partitions() and all(x["error"] == "file too large" for p in reader(folder, maxBytes=0).partitions() for b in reader(folder, maxBytes=0).read(p) for x in b.to_pylist() if x["size"])


def test_partitions_by_bytes(folder):
    r = reader(folder, partitionBytes=datasource.OPEN_BYTES + 10)
    parts = r.partitions()
    assert len(parts) == 10 and all(len(p.files) == 1 for p in parts)
    assert len(reader(folder).partitions()) == 1
    with pytest.raises(FileNotFoundError):
        reader(folder + "/none").partitions()


def test_pushed_filters_in_the_plan(spark, folder):
    rows = datasource.planned_scan(spark, folder, ["path", "size", "type"]).where("type = 'csv' and size < 100 and path like '%b%'")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    assert [os.path.basename(r.path) for r in rows.collect()] == ["b.csv"]


def test_planned_pieces(spark, folder):
    small = files.scan(spark, folder, most_bytes=1 << 20).where("error is null")
    cols = ["piece", "mode", "type", "text", "attrs", "confidence", "page"]
    want = sorted((os.path.basename(r.source), *map(str, (r[c] for c in cols))) for r in parsers.parse(small).collect())
    got = datasource.planned_pieces(spark, folder, maxBytes=1 << 20, ignore="*i.md").collect()
    assert sorted((os.path.basename(r.source), *map(str, (r[c] for c in cols))) for r in got if "huge" not in r.source) == want
    assert [r.parse_error for r in got if "huge" in r.source] == ["file too large"]
    assert any(r.parse_error for r in got if "g.json" in r.source)
    mine = datasource.planned_pieces(spark, folder, {"log": "tests.test_sources:shout"}, glob="*.log").collect()
    assert [r.text for r in mine] == ["LOUD"]


# line formats


def split(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


@pytest.fixture
def splits(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: split(spark, size)
    for k, v in was.items():
        spark.conf.set(k, v)


def jsonl_text(r, n):
    out = []
    for k in range(n):
        kind = r.integers(0, 9)
        value = {"id": int(k), "v": ["a", 1.5, None, {"deep": [k]}], "q": "x" * int(r.integers(0, 60))}
        out.append(["", "  ", "{broken", json.dumps(k), "[]", json.dumps(value), json.dumps({"u": "é ü"}, ensure_ascii=False), json.dumps(value), '{"a": 1}\x0b{"b": 2}'][kind])
    return out


@pytest.mark.parametrize("seed,size", [(0, 97), (1, 1000), (2, 1 << 20)])
def test_jsonl_blocks(spark, tmp_path, splits, seed, size):
    splits(size)
    r = np.random.default_rng(seed)
    texts = {f"{k}.jsonl": end.join(jsonl_text(r, n)) + tail for k, (n, end, tail) in enumerate([(300, "\n", "\n"), (40, "\r\n", ""), (1, "\n", ""), (90, "\n", "\n\n")])}
    texts["empty.jsonl"] = ""
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    for limit in (structured.LIMIT, 7, None):
        got: dict = {}
        for x in lines.jsonl_blocks(spark, str(tmp_path), limit).orderBy("path", "line", "pos").collect():
            got.setdefault(os.path.basename(x.path), []).append((x.type, x.text, x.attrs, x.confidence))
        for name, t in texts.items():
            every = [row for n, line in enumerate(t.splitlines(), 1) for row in structured.line_rows(n, line)]
            want = structured.limited(iter(every), limit) if limit else every
            assert got.get(name, []) == want, (name, limit)
    meta = {os.path.basename(x.path): x for x in lines.jsonl_metadata(spark, str(tmp_path)).collect()}
    for name, m in meta.items():
        want = payloads.load_jsonl(texts[name].encode())[1]
        assert (str(m.lines), str(m.valid_in_sample), m.sample_keys) == (want["lines"], want["valid_in_sample"], want["sample_keys"])


def csv_text(r, n, end):
    cell = lambda: ["plain", "", "a b", '"quoted"', '"with ""two"" in"', f'"over{end}lines{end}{end}here"', 'mid"dle', '"ab"c"d', "x\x0by"][r.integers(0, 9)]
    return end.join("" if r.integers(0, 12) == 0 else ",".join(cell() for _ in range(r.integers(1, 5))) for _ in range(n))


@pytest.mark.parametrize("seed,size", [(0, 61), (1, 400), (2, 1 << 20)])
def test_csv_records(spark, tmp_path, splits, monkeypatch, seed, size):
    splits(size)
    r = np.random.default_rng(seed)
    texts = {f"{k}.csv": csv_text(r, n, "\n") + tail for k, (n, tail) in enumerate([(200, "\n"), (30, ""), (1, ""), (60, '\n"never closed\nto the, end')])}
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    want = {name: list(parsers.csv.reader(parsers.io.StringIO(t, newline=""))) for name, t in texts.items()}
    for most in (lines.MOST_SPLITS, 0):
        monkeypatch.setattr(lines, "MOST_SPLITS", most)
        records = lines.csv_records(spark, str(tmp_path))
        got: dict = {}
        for x in records.orderBy("path", "record").collect():
            assert x.record == len(got.setdefault(os.path.basename(x.path), [])) + 1
            got[os.path.basename(x.path)].append(x.cells)
        assert got == want
    for x in lines.csv_tables(records).collect():
        (_, _, text, attrs, _, _) = next(parsers.parse_csv(texts[os.path.basename(x.path)].encode()))
        assert (x.text, x.attrs) == (text, attrs)
    assert sum(len(json.loads(x.attrs["rows"])) for x in lines.csv_tables(records, 7).collect()) == sum(map(len, want.values()))
