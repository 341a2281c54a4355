"""Files of all types as a stream: the rows of a batch conversion, none twice after a restart."""

import time

from blockloom.plans.convert import convert
from blockloom.sources import event_log
from blockloom.streaming.files import stream_files, streamed

FIRST = {"a.md": b"# Head\n\nSome text here.\n- item one", "b.csv": b"x,y\n1,2\n", "c.json": b'{"k": [1, null]}', "d.txt": "Zeile ü\n\nzwei".encode(), "e.json": b"{broken", "f.jsonl": b'{"a": 1}\n{"b": 2}\n'}
MORE = {"g.html": b"<h1>Title</h1><p>Words and more words</p>", "sub/h.ini": b"[s]\nk = v\n"}


def put(root, files):
    for name, data in files.items():
        p = root / name
        p.parent.mkdir(exist_ok=True, parents=True)
        p.write_bytes(data)
    time.sleep(0.01)


def shown(rows):
    return sorted((r.source, r.pos, r.type, r.text, round(r.confidence, 6), r.parse_error is None) for r in rows.collect())


def test_stream_of_all_types(spark, tmp_path):
    src, path = tmp_path / "src", str(tmp_path / "out")
    put(src, FIRST)

    def run(checkpoint):
        q = stream_files(spark, str(src), path, str(tmp_path / checkpoint), most_bytes=1 << 20)
        q.awaitTermination(120)
        assert q.exception() is None

    run("c1")
    blocks, documents = convert(spark, str(src))
    assert shown(streamed(spark, path)) == shown(blocks)
    assert streamed(spark, path, "documents").count() == len(FIRST)
    run("lost")  # the same batch again under its number, as after a restart whose checkpoint was lost
    event_log.uncommit(spark, f"{path}/documents", f"{0:020d}")  # as if killed between the two logs
    run("lost too")
    put(src, MORE)
    with open(src / "huge.txt", "wb") as f:
        f.truncate(3 << 30)
    run("c1")
    blocks, _ = convert(spark, str(src), most_bytes=1 << 20)
    assert shown(streamed(spark, path)) == shown(blocks)
    errors = {r.uri.rsplit("/", 1)[1]: r.error for r in streamed(spark, path, "documents").collect()}
    assert len(errors) == len(FIRST) + len(MORE) + 1 and errors["huge.txt"] == "file too large"
