"""Parsers: a file's content to pieces, one table function per format.

A parser yields (mode, type, text, attrs, confidence, page). Mode `block` is a finished block. `chunk` is still to be cut
to size and classified, `text` to be cut into paragraphs first: that is done for all formats at once by the column
expressions of operators.text_blocks, so a parser only does what needs the format's grammar.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterable, Iterator
from email import policy
from email.parser import BytesParser
from itertools import accumulate, chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import html, images, office, structured

#: Pieces that are handed back at a time; finished blocks that one row carries at most, and the letters at which it is full.
BATCH, RUN, RUN_LETTERS = 10_000, 1000, 1 << 20

Piece = tuple[str, str | None, str, dict, float | None, int | None]
PIECE = "doc_id bigint, source string, piece int, mode string, type string, text string, attrs map<string,string>, confidence double, page int, parse_error string"
#: PIECE rows where successive finished blocks are one row, of mode `run`, numbered as the first of them.
RUNS = PIECE + ", blocks array<struct<type:string,text:string,attrs:map<string,string>,confidence:double,page:int>>"

# fixed values: list marks and confidences
LIST_MARK = re.compile(r"^(?:[-*•・]|\d+[.)])\s+")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
HTML_CONFIDENCE = {"title": 0.9, "heading": 0.85, "list_item": 0.7, "code": 0.75, "table": 0.8}


def _block(kind: str, text: str, confidence: float, attrs: dict | None = None, page: int | None = None) -> Piece:
    return "block", kind, text, attrs or {}, confidence, page


def _chunk(text: str, least: float | None = None, attrs: dict | None = None) -> Piece:
    return "chunk", None, text, attrs or {}, least, None


def _rows_text(rows: list[list[str]]) -> str:
    return "\n".join(", ".join(r) for r in rows)


def _table(rows: list[list[str]], confidence: float) -> Piece:
    return _block("table", _rows_text(rows), confidence, {"rows": json.dumps(rows, ensure_ascii=False)})


def _utf8(data: bytes) -> str:
    return data.decode("utf-8", "ignore")


def parse_text(data: bytes) -> Iterator[Piece]:
    yield "text", None, _utf8(data), {}, None, None


def parse_markdown(data: bytes) -> Iterator[Piece]:
    """Fenced code, # headings, list lines; any other line is a chunk of its own. An open fence ends with the file."""
    text, fence, any_ = _utf8(data), None, False
    for line in text.splitlines():
        if line.startswith("```"):
            if fence is not None:
                yield _block("code", "\n".join(fence), 0.7)
                any_ = True
            fence = [] if fence is None else None
        elif fence is not None:
            fence.append(line)
        elif line.startswith("#"):
            any_ = True
            yield _block("heading", line.lstrip("# "), 0.8)
        elif line:
            any_ = True
            yield _chunk(line)
    if fence:
        yield _block("code", "\n".join(fence), 0.7)
    elif not any_:
        yield _block("other", text, 0.3)


def parse_html(data: bytes) -> Iterator[Piece]:
    """Titles, headings, paragraphs, list items, code and tables in document order; nested ones are given again."""
    root, any_ = html.tree(_utf8(data)), False
    kinds = {"title": "title", "li": "list_item", "pre": "code", "code": "code", "table": "table", "p": None} | dict.fromkeys(HEADINGS, "heading")
    for node in root.walk():
        if node.name not in kinds or not (text := node.text()):
            continue
        any_, kind = True, kinds[node.name]
        if kind is None:
            yield _chunk(text)
        elif kind == "table":
            rows = [[c.text() for c in r.walk() if c.name in ("td", "th")] for r in node.walk() if r.name == "tr"]
            yield _table(rows, HTML_CONFIDENCE["table"])
        else:
            yield _block(kind, text, HTML_CONFIDENCE[kind])
    if not any_:
        yield _block("paragraph", root.text("\n"), 0.4)


def parse_csv(data: bytes, sep: str = ",") -> Iterator[Piece]:
    yield _table(list(csv.reader(io.StringIO(_utf8(data), newline=""), delimiter=sep)), 0.8)


def parse_pdf(data: bytes) -> Iterator[Piece]:
    """Pages as text. Needs the optional library pypdf."""
    from pypdf import PdfReader

    for n, page in enumerate(PdfReader(io.BytesIO(data)).pages):
        yield "text", None, page.extract_text() or "", {"page": str(n + 1)}, None, n


def parse_image(data: bytes) -> Iterator[Piece]:
    """A summary and the texts that an image carries. Recognised text goes through operators.visual.image_blocks."""
    meta, said = images.describe(data)
    if meta:
        yield _block("metadata", "Image summary", 0.45, meta)
    for key, text, where in said:
        yield _block("metadata", text, 0.6, {"image_source": where, "length": str(len(text)), "key": key})
    if not meta and not said:
        yield _block("metadata", "Image contained no extractable text", 0.35, {"image_has_text": "false"})


def parse_docx(data: bytes) -> Iterator[Piece]:
    paragraphs, tables = office.docx(data)
    for style, text in paragraphs:
        if text.strip():
            yield _chunk(text, 0.65, {"_heading": "1"} if "heading" in style.lower() else None)
    for rows in tables:
        yield _table(rows, 0.75)


def parse_pptx(data: bytes) -> Iterator[Piece]:
    for n, texts in enumerate(office.pptx(data), 1):
        for t in texts:
            yield _chunk(t, 0.6, {"slide": str(n)})


def parse_xlsx(data: bytes) -> Iterator[Piece]:
    sheets = office.xlsx(data, None, active=True)
    yield _table(sheets[0][1] if sheets else [], 0.75)


def parse_eml(data: bytes) -> Iterator[Piece]:
    """Headers, plain bodies (HTML ones as text where there is no plain one), ten attachments at most."""
    mail = BytesParser(policy=policy.default).parsebytes(data)
    head = {k: str(mail.get(k, "")) for k in ("subject", "from", "to", "cc", "date")}
    shown = "\n".join(f"{k.capitalize()}: {head[k]}" for k in ("subject", "from", "to")).strip()
    yield _block("meta", shown, 0.85, {k: v for k, v in head.items() if v})
    plain, rich, files = [], [], []
    for part in mail.walk():
        if part.is_multipart():
            continue
        body, kind = part.get_payload(decode=True) or b"", part.get_content_type()
        if name := part.get_filename():
            files.append({"filename": name, "content_type": kind, "size": str(len(body))})
        elif kind.startswith("text/"):
            try:
                text = body.decode(part.get_content_charset() or "utf-8", "ignore")
            except LookupError:
                text = _utf8(body)
            (plain if kind == "text/plain" else rich).append(text)
    for text in plain or [t for t in (html.tree(x).text() for x in rich) if t]:
        yield "text", None, text, {"_no_table": "1"}, None, None
    for f in files[:10]:
        yield _block("attachment", f["filename"], 0.4, f)


def parse_ics(data: bytes) -> Iterator[Piece]:
    """Events with their properties, names in lower case; folded lines are joined."""
    lines: list[str] = []
    for line in _utf8(data).splitlines():
        if lines and line[:1] in (" ", "\t"):
            lines[-1] += line.strip()
        else:
            lines.append(line)
    now: dict[str, str] = {}
    any_ = False
    for line in lines:
        mark = line.upper()
        if mark == "END:VEVENT" and now:
            any_ = True
            shown = [now.get("SUMMARY", "Event")]
            shown += [f"{name}: {now[key]}" for key, name in (("DTSTART", "Start"), ("DTEND", "End"), ("LOCATION", "Location")) if key in now]
            shown += [now["DESCRIPTION"]] if "DESCRIPTION" in now else []
            yield _block("event", "\n".join(shown), 0.75, {k.lower(): v for k, v in now.items()})
        if mark in ("BEGIN:VEVENT", "END:VEVENT"):
            now = {}
        elif ":" in line:
            key, _, value = line.partition(":")
            now[key.strip().upper()] = value.strip()
    if not any_:
        yield _block("other", "\n".join(lines), 0.3)


def _structured(kind: str) -> Callable[[bytes], Iterator[Piece]]:
    def parse(data: bytes) -> Iterator[Piece]:
        for t, text, attrs, level in structured.READERS[kind](_utf8(data)):
            yield _block(t, text, level, attrs)

    return parse


PARSERS: dict[str, Callable[[bytes], Iterable[Piece]]] = {
    "text": parse_text,
    "md": parse_markdown,
    "html": parse_html,
    "csv": parse_csv,
    "pdf": parse_pdf,
    "image": parse_image,
    "docx": parse_docx,
    "pptx": parse_pptx,
    "xlsx": parse_xlsx,
    "eml": parse_eml,
    "ics": parse_ics,
} | {k: _structured(k) for k in structured.READERS}

#: Types that a MIME type stands for, before the file's own type is asked.
BY_MIME = {"text/markdown": "md", "text/html": "html", "text/csv": "csv", "application/pdf": "pdf", "application/json": "json", "application/x-ndjson": "jsonl", "application/yaml": "yaml", "application/toml": "toml", "message/rfc822": "eml", "text/calendar": "ics"}


def register_parser(kind: str, parse: Callable[[bytes], Iterable[Piece]], also: Iterable[str] = ()) -> None:
    """Add or replace the parser of a type, and of further types or MIME types."""
    PARSERS[kind] = parse
    for other in also:
        if "/" in other:
            BY_MIME[other] = kind
        else:
            PARSERS[other] = parse


def _reader() -> Callable[[str, str | None, bytes | None], tuple[list[Piece], str | None]]:
    """What gives a file's pieces by the parsers as they are registered now, and why it had to be read as text."""
    parsers, by_mime = dict(PARSERS), dict(BY_MIME)

    def read(kind: str, mime: str | None, content: bytes | None) -> tuple[list[Piece], str | None]:
        data = bytes(content or b"")
        try:
            found = list(parsers.get(by_mime.get(mime or "") or kind, parse_text)(data))
            if not found:
                raise ValueError("no blocks")
        except Exception as e:  # noqa: BLE001  any broken file falls back to plain text
            return list(parse_text(data)), f"{type(e).__name__}: {e}"
        return found, None

    return read


def parse(files: DataFrame) -> DataFrame:
    """PIECE rows of files (doc_id, path, type, mime, content). What a parser can't read is read as text, with parse_error."""
    read = _reader()
    names = [c.split()[0] for c in PIECE.replace("map<string,string>", "map").split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"page": "Int32", "confidence": "float64"})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out: list[tuple] = []
            for r in p.itertuples(index=False):
                found, error = read(r.type, r.mime, r.content)
                for k, (mode, kind, text, attrs, level, page) in enumerate(found):
                    out.append((r.doc_id, r.path, k, mode, kind, text, attrs, level, page, error))
                    if len(out) >= BATCH:
                        yield frame(out)
                        out = []
            yield frame(out)

    return files.select("doc_id", "path", "type", "mime", "content").mapInPandas(run, PIECE)


def in_runs(pieces: list[Piece]) -> Iterator[tuple[int, list[Piece]]]:
    """Successive finished blocks together, RUN and about RUN_LETTERS at most, and any other piece alone; with the first one's number."""
    start, letters = 0, 0
    for k, (mode, _, text, attrs, _, _) in enumerate(pieces):
        more = len(text or "") + sum(map(len, filter(None, (attrs or {}).values())))
        if k > start and (mode != "block" or pieces[start][0] != "block" or k - start >= RUN or letters + more > RUN_LETTERS):
            yield start, pieces[start:k]
            start, letters = k, 0
        letters += more
    if pieces:
        yield start, pieces[start:]


def _maps(values: list[dict | None]) -> pa.Array:
    """Maps of strings, an empty one for None."""
    values = [v or {} for v in values]
    ends = list(accumulate(map(len, values), initial=0))
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(list(chain.from_iterable(values)), pa.string()), pa.array(list(chain.from_iterable(v.values() for v in values)), pa.string()))


def _fields(pieces: list[Piece | tuple]) -> list[pa.Array]:
    """Columns type, text, attrs, confidence, page of pieces."""
    _, kinds, texts, attrs, levels, pages = zip(*pieces) if pieces else ((),) * 6
    return [pa.array(kinds, pa.string()), pa.array(texts, pa.string()), _maps(list(attrs)), pa.array(levels, pa.float64()), pa.array(pages, pa.int32())]


def parse_runs(files: DataFrame, attrs: bool = True) -> DataFrame:
    """RUNS rows of files: what parse gives, but finished blocks go on together, as nothing is cut or classified in them.

    attrs: whether the blocks of runs keep theirs; Spark can't tell the parser that a query doesn't read them.
    """
    read = _reader()
    none = (None,) * 6

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        docs, paths, numbers, found, errors = zip(*rows)
        finished = [f[0][0] == "block" for f in found]
        alone = _fields([none if done else f[0] for done, f in zip(finished, found)])
        blocks = [p if attrs else (*p[:3], None, *p[4:]) for done, f in zip(finished, found) if done for p in f]
        ends = list(accumulate((len(f) if done else 0 for done, f in zip(finished, found)), initial=0))
        struct = pa.StructArray.from_arrays(_fields(blocks), ["type", "text", "attrs", "confidence", "page"])
        mode = pa.array(["run" if done else f[0][0] for done, f in zip(finished, found)], pa.string())
        columns = [pa.array(docs, pa.int64()), pa.array(paths, pa.string()), pa.array(numbers, pa.int32()), mode, *alone, pa.array(errors, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "piece", "mode", "type", "text", "attrs", "confidence", "page", "parse_error", "blocks"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            out: list[tuple] = []
            size = 0
            for doc, path, kind, mime, content in zip(*(c.to_pylist() for c in p.columns)):
                found, error = read(kind, mime, content)
                for k, some in in_runs(found):
                    out.append((doc, path, k, some, error))
                    size += len(some)
                    if size >= BATCH:
                        yield batch(out)
                        out, size = [], 0
            if out:
                yield batch(out)

    return files.select("doc_id", "path", "type", "mime", "content").mapInArrow(run, RUNS)
