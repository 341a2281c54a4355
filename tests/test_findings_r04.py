"""What took too long on large tables: finished blocks are one row a run, on all cores, with the same blocks as before."""

import pytest

from blockloom.operators.text_blocks import refine_pieces
from blockloom.plans import format_queries
from blockloom.sources import parsers
from test_findings_r03 import against_sql

FILES = "doc_id long, path string, type string, mime string, content binary"
MAIL = b"Subject: S\nFrom: a@b.example\nContent-Type: multipart/mixed; boundary=x\n\n--x\nContent-Type: text/plain\n\nDear all,\n\na, b\nc, d\n--x\nContent-Disposition: attachment; filename=f.bin\n\nzz\n--x--\n"
ODD = [
    ("md", "\n".join(f"# heading {k}" for k in range(2500))),
    ("md", "# one\nName: value\n- item\n```\ncode\n```\n## two\n### three\nplain words\n" + "long words. " * 200),
    ("md", ""),
    ("html", "<title>T</title><h1>H</h1><p>Para one.</p><ul><li>x</li></ul><table><tr><td>1</td><td>2</td></tr></table><p>Last</p>"),
    ("json", "[" + ",".join(map(str, range(450))) + "]"),
    ("json", '{"a": {"": null, "odd key": "é"}, "b": [1, {"c": []}], "": {"x": 1}}'),
    ("json", "{broken: [\n\na, b\nc, d"),
    ("jsonl", '{"k": 1}\n\nno json\n[2]\n'),
    ("json", None),
    ("text", ""),
    ("text", "Name: x\n\na, b\nc, d\n\n" + "Some words here. " * 100),
    ("docx", "no zip"),
    ("eml", MAIL.decode()),
    ("ini", "a -> 1\n[s]\nb = 2\n"),
]


def test_runs_give_the_blocks_of_pieces(spark, monkeypatch):
    def hidden(data: bytes):
        """Attributes that begin with _ steer the cutting and are not shown."""
        yield "block", "paragraph", data.decode(), {"_own": "1", "seen": "2"}, None, 3
        yield "block", "other", None, None, 0.5, None
        yield "chunk", None, "Name: x", {"_own": "1"}, 0.9, 4
        yield "block", "paragraph", "", {}, 0.5, None

    monkeypatch.setitem(parsers.PARSERS, "hidden", hidden)
    rows = [(n, f"f/{n}", kind, "application/octet-stream", None if text is None else bytearray(text.encode())) for n, (kind, text) in enumerate([*ODD, ("hidden", "x")])]
    files = spark.createDataFrame(rows, FILES)
    want, got = refine_pieces(parsers.parse(files)), refine_pieces(parsers.parse_runs(files))
    assert got.dtypes == want.dtypes
    shown = lambda df: [repr(r.asDict()) for r in df.orderBy("doc_id", "pos").collect()]
    assert shown(got) == shown(want)
    assert parsers.parse_runs(files).where("doc_id = 0").count() == 3
    bare = refine_pieces(parsers.parse_runs(files, attrs=False))
    assert shown(bare.drop("attrs")) == shown(want.drop("attrs"))


def test_runs_are_bounded():
    block, chunk = ("block", "kv", "x" * 9, {"k": "v"}, 0.5, None), ("chunk", None, "x", {}, None, None)
    pieces = [chunk, chunk, *[block] * 2001, chunk, block]
    runs = list(parsers.in_runs(pieces))
    assert [(k, len(r)) for k, r in runs] == [(0, 1), (1, 1), (2, 1000), (1002, 1000), (2002, 1), (2003, 1), (2004, 1)]
    assert [p for _, r in runs for p in r] == pieces
    large = ("block", "kv", "x" * (parsers.RUN_LETTERS // 2), {}, 0.5, None)
    assert [len(r) for _, r in parsers.in_runs([large] * 5)] == [2, 2, 1] and list(parsers.in_runs([])) == []


@pytest.fixture
def suppliers():
    return [(k, f"Supplier {k}", k % 25, 0.0) for k in range(40)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"


def test_truncation_marker_like_sql(spark, tmp_path, suppliers):
    got, want = against_sql(spark, tmp_path, "truncation_marker", supplier=suppliers)
    assert got == want and len(got) == 40


def test_suppliers_files_are_parsed_on_all_cores(spark, tmp_path, suppliers):
    """A table in one file: its rows are dealt to all cores, and a file's blocks are one row until they are numbered."""
    spark.createDataFrame(*suppliers).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    files = format_queries._supplier(spark, str(tmp_path), format_queries._ini(), "ini")
    assert files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert parsers.parse_runs(files).count() == 40
