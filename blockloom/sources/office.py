"""Text of Office files, which are zip archives of XML."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _open(data: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(data))


def _joined(node, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter(tag))


def docx(data: bytes) -> tuple[list[tuple[str, str]], list[list[list[str]]]]:
    """((style, text) of paragraphs outside tables, tables)."""
    with _open(data) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    paragraphs, tables = [], []
    for node in body if body is not None else ():
        if node.tag == f"{W}p":
            style = node.find(f"{W}pPr/{W}pStyle")
            paragraphs.append((style.get(f"{W}val", "") if style is not None else "", _joined(node, f"{W}t")))
        elif node.tag == f"{W}tbl":
            tables.append([["\n".join(_joined(p, f"{W}t") for p in c.iter(f"{W}p")) for c in r.findall(f"{W}tc")] for r in node.iter(f"{W}tr")])
    return paragraphs, tables


def pptx(data: bytes) -> list[list[str]]:
    """Texts of each slide, in the order of the slides' numbers."""
    with _open(data) as z:
        names = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))]
        slides = [ElementTree.fromstring(z.read(n)) for _, n in sorted(names)]
    return [[t for p in s.iter(f"{A}p") if (t := _joined(p, f"{A}t")).strip()] for s in slides]


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _sheets(z: zipfile.ZipFile) -> tuple[list[tuple[str, str]], int]:
    """(name, part) of the sheets in the order of the workbook, and the place of the active one."""
    files = set(z.namelist())
    matches = [m for m in (re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n) for n in files) if m]
    numbered = [m[0] for m in sorted(matches, key=lambda m: int(m[1]))]
    if "xl/workbook.xml" not in files:
        return [(f"sheet{k}", n) for k, n in enumerate(numbered, 1)], 0
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    targets = {}
    if "xl/_rels/workbook.xml.rels" in files:
        for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
            target = r.get("Target", "")
            targets[r.get("Id")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    found = []
    for k, sheet in enumerate(book.iter(f"{S}sheet")):
        part = targets.get(sheet.get(f"{R}id"), numbered[k] if k < len(numbered) else "")
        if part in files:
            found.append((sheet.get("name", ""), part))
    view = next(book.iter(f"{S}workbookView"), None)
    active = int(view.get("activeTab", "0")) if view is not None else 0
    return found, active if active < len(found) else 0


def _sheet_rows(xml: bytes, shared: list[str], most_rows: int | None) -> list[list[str]]:
    rows: list[list[str]] = []
    for r in ElementTree.fromstring(xml).iter(f"{S}row"):
        if most_rows is not None and len(rows) >= most_rows:
            break
        cells: list[str] = []
        for c in r.iter(f"{S}c"):
            cells += [""] * (_column(c.get("r", "")) - 1 - len(cells))
            kind, v = c.get("t"), c.find(f"{S}v")
            value = v.text or "" if v is not None else _joined(c, f"{S}t")
            cells.append(shared[int(value)] if kind == "s" and value else {"0": "False", "1": "True"}.get(value, value) if kind == "b" else value)
        rows.append(cells)
    return rows


def xlsx(data: bytes, most_rows: int | None = 10_001, active: bool = False) -> list[tuple[str, list[list[str]]]]:
    """(sheet, rows) in the order of the workbook, with at most `most_rows` rows a sheet (None: all). active: that sheet only."""
    with _open(data) as z:
        shared = [_joined(si, f"{S}t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        sheets, at = _sheets(z)
        return [(name, _sheet_rows(z.read(part), shared, most_rows)) for name, part in (sheets[at : at + 1] if active else sheets)]


def zip_index(data: bytes, first: int = 20) -> tuple[int, list[str]]:
    with _open(data) as z:
        names = z.namelist()
    return len(names), names[:first]


def rtf(text: str) -> str:
    """Text of an RTF file: control words and braces go, \\'hh is Latin-1, \\par and \\line end lines, \\tab is a tab."""
    breaks = {"par": "\n", "line": "\n", "tab": "\t"}

    def said(m: re.Match) -> str:
        if m["hex"]:
            return bytes.fromhex(m["hex"]).decode("latin-1")
        return m["char"] or breaks.get(m["word"] or "", "")

    pattern = r"\\'(?P<hex>[0-9a-fA-F]{2})|\\(?P<word>[a-zA-Z]+)-?\d* ?|\\(?P<char>[\\{}])|\\.|[{}\r\n]"
    return re.sub(pattern, said, text).strip()
