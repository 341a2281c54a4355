"""Payloads: a file as one text with metadata."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import tomllib
from collections.abc import Callable, Iterator
from email import policy
from email.parser import BytesParser
from xml.etree import ElementTree

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.segment import newlines, words
from . import html, images, office

# fixed values: limits of previews and samples
PREVIEW, SAMPLE_LINES, MOST_ATTACHMENTS, FIRST_NAMES = 32, 50, 10, 20

Loaded = tuple[str, dict]


def preview(content: Column) -> Column:
    """Length, SHA-256 and the first bytes of a binary."""
    return F.struct(F.length(content).alias("length"), F.sha2(content, 256).alias("sha256"), F.base64(F.substring(content, 1, PREVIEW)).alias("head"))


def checksum(data: bytes, algorithm: str = "sha256") -> str:
    return hashlib.blake2b(data, digest_size=32).hexdigest() if algorithm == "blake2b" else hashlib.new(algorithm, data).hexdigest()


def text_metadata(text: Column, size: Column | None = None) -> Column:
    """size, line_count, char_count and word_count as a map; the counts only for a text that is not empty."""
    counts = F.create_map(
        F.lit("line_count"), (F.regexp_count(text, F.lit("\n")) + 1).cast("string"), F.lit("char_count"), F.length(text).cast("string"), F.lit("word_count"), F.size(words(text)).cast("string")
    )
    out = F.when(F.length(text) > 0, counts).otherwise(F.create_map().cast("map<string,string>"))
    return out if size is None else F.map_concat(out, F.create_map(F.lit("size"), size.cast("string")))


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace").lstrip("﻿")


def load_json(data: bytes) -> Loaded:
    text = _text(data)
    try:
        value = json.loads(text)
    except ValueError as e:
        return text, {"json_valid": "false", "error": str(e)}
    meta = {"json_valid": "true", "top_level": type(value).__name__}
    if isinstance(value, dict):
        meta["keys"] = json.dumps(sorted(value), ensure_ascii=False)
    return json.dumps(value, ensure_ascii=False, indent=2), meta


def load_jsonl(data: bytes) -> Loaded:
    text = _text(data)
    lines = [x for x in text.splitlines() if x.strip()]
    good, keys = 0, []
    for x in lines[:SAMPLE_LINES]:
        try:
            value = json.loads(x)
        except ValueError:
            continue
        good += 1
        if isinstance(value, dict):
            keys.append(sorted(value))
    return text, {"lines": str(len(lines)), "valid_in_sample": str(good), "sample_keys": json.dumps(keys[:5], ensure_ascii=False)}


def load_yaml(data: bytes) -> Loaded:
    text = _text(data)
    try:
        docs = list(yaml.safe_load_all(text))
    except yaml.YAMLError as e:
        return text, {"yaml_valid": "false", "error": str(e)}
    meta = {"yaml_valid": "true", "documents": str(len(docs)), "types": json.dumps([type(d).__name__ for d in docs[:5]])}
    if docs and isinstance(docs[0], dict):
        meta["keys"] = json.dumps(sorted(map(str, docs[0])), ensure_ascii=False)
    return text, meta


def load_toml(data: bytes) -> Loaded:
    text = _text(data)
    try:
        value = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        return text, {"toml_valid": "false", "error": str(e)}
    return text, {"toml_valid": "true", "keys": json.dumps(sorted(value)), "tables": str(sum(isinstance(v, dict) for v in value.values()))}


def load_markdown(data: bytes) -> Loaded:
    text = _text(data)
    if m := re.match(r"---\n(.*?)\n---\n", text, re.S):
        try:
            head = yaml.safe_load(m[1])
        except yaml.YAMLError:
            head = None
        if isinstance(head, dict):
            return text[m.end() :], {"front_matter": json.dumps(head, ensure_ascii=False, default=str)}
    return text, {}


def load_html(data: bytes) -> Loaded:
    text = _text(data)
    return html.plain(text), {"title": html.title(html.tree(text)), "html_length": str(len(text))}


def load_xml(data: bytes) -> Loaded:
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        return _text(data), {"xml_valid": "false", "error": str(e)}
    meta = {"xml_valid": "true", "root": root.tag, "children": str(len(root)), "elements": str(sum(1 for _ in root.iter()))}
    ElementTree.indent(root)
    return ElementTree.tostring(root, encoding="unicode"), meta


def load_rtf(data: bytes) -> Loaded:
    return office.rtf(data.decode("latin-1")), {}


def load_eml(data: bytes) -> Loaded:
    mail = BytesParser(policy=policy.default).parsebytes(data)
    bodies, rich, names = [], [], []
    for part in mail.walk():
        if part.is_multipart():
            continue
        if name := part.get_filename():
            names.append(name)
        elif part.get_content_type() == "text/plain":
            bodies.append(part.get_content())
        elif part.get_content_type() == "text/html":
            rich.append(re.sub(r"<[^>]+>", " ", part.get_content()))
    meta = {k: str(mail[k]) for k in ("subject", "from", "to", "cc", "date") if mail[k]}
    meta["attachments"] = json.dumps(names[:MOST_ATTACHMENTS], ensure_ascii=False)
    return "\n\n".join(x.strip() for x in bodies or rich), meta


def load_ics(data: bytes) -> Loaded:
    text = _text(data)
    up = text.upper()
    return text, {"events": str(up.count("BEGIN:VEVENT")), "has_tzid": str("TZID" in up).lower(), "has_alarm": str("BEGIN:VALARM" in up).lower()}


def load_docx(data: bytes) -> Loaded:
    rows = [t for _, t in office.docx(data)[0]]
    return "\n".join(rows), {"paragraphs": str(len(rows))}


def load_pptx(data: bytes) -> Loaded:
    slides = office.pptx(data)
    return "\n\n".join("\n".join(s) for s in slides), {"slides": str(len(slides))}


def load_xlsx(data: bytes) -> Loaded:
    sheets = office.xlsx(data)
    return "\n\n".join("\n".join("\t".join(r) for r in rows) for _, rows in sheets), {"sheets": json.dumps([n for n, _ in sheets], ensure_ascii=False)}


def load_pdf(data: bytes, most_pages: int = 400) -> Loaded:
    import io

    from pypdf import PdfReader

    pages = PdfReader(io.BytesIO(data)).pages
    return "\n\n".join(p.extract_text() or "" for p in pages[:most_pages]), {"pages": str(len(pages))}


def load_zip(data: bytes) -> Loaded:
    n, names = office.zip_index(data, FIRST_NAMES)
    return "\n".join(names), {"entries": str(n)}


def load_binary(data: bytes) -> Loaded:
    return "", {"sha256": checksum(data), "length": str(len(data)), "preview": base64.b64encode(data[:PREVIEW]).decode()}


def load_image(data: bytes) -> Loaded:
    meta, said = images.describe(data)
    return images.joined([t for _, t, _ in said]), meta | load_binary(data)[1]


LOADERS: dict[str, Callable[[bytes], Loaded]] = {
    "application/json": load_json,
    "application/x-ndjson": load_jsonl,
    "application/yaml": load_yaml,
    "application/toml": load_toml,
    "application/xml": load_xml,
    "text/html": load_html,
    "text/markdown": load_markdown,
    "text/rtf": load_rtf,
    "message/rfc822": load_eml,
    "text/calendar": load_ics,
    "application/pdf": load_pdf,
    "application/zip": load_zip,
    **dict.fromkeys(("image/png", "image/jpeg", "image/gif", "image/bmp", "image/tiff", "image/webp"), load_image),
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": load_docx,
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": load_pptx,
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": load_xlsx,
}


def payloads(files: DataFrame) -> DataFrame:
    """Scanned files as (path, mime, text, meta, error). Plain text stays in the JVM; other formats go through Arrow batches."""
    from .files import decoded

    loaders = dict(LOADERS)

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for mime, content in parts:
            out = []
            for m, c in zip(mime, content):
                if c is None:
                    out.append((None, None, None))
                    continue
                try:
                    text, meta = loaders.get(m, load_binary)(bytes(c))
                    out.append((text, json.dumps(meta), None))
                except Exception as e:  # noqa: BLE001  a broken or unsupported file is a row's error
                    text, meta = load_binary(bytes(c))
                    out.append((text, json.dumps(meta), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["text", "meta", "error"], dtype=object)

    plain = F.col("mime").startswith("text/") & ~F.col("mime").isin(*loaders)
    rows = files.withColumn("_d", decoded(F.when(plain, F.col("content"))))
    rows = rows.withColumn("_l", F.pandas_udf(run, "text string, meta string, error string")("mime", F.when(~plain, F.col("content"))))
    text = F.when(plain, newlines(F.col("_d.text"))).otherwise(newlines(F.col("_l.text")))
    none = F.create_map().cast("map<string,string>")
    own = F.coalesce(F.from_json("_l.meta", "map<string,string>"), none)
    own = F.when(plain, F.create_map(F.lit("encoding"), F.col("_d.encoding"))).otherwise(own)
    rows = rows.select("path", "mime", text.alias("text"), "size", "modified_at", own.alias("own"), F.coalesce("error", "_l.error").alias("error"))
    stamp = F.create_map(F.lit("modified_at"), F.date_format("modified_at", "yyyy-MM-dd'T'HH:mm:ssXXX"))
    base = F.map_concat(text_metadata(F.coalesce("text", F.lit("")), F.col("size")), stamp)
    meta = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key("own", k)), F.col("own"))
    return rows.select("path", "mime", "text", meta.alias("meta"), "error")


def ocr_lines(tokens: DataFrame) -> DataFrame:
    """Recognised tokens (doc_id, page, block, par, line, word, text, x0, y0, x1, y1, conf) as lines with joined boxes and mean confidence."""
    words_ = F.array_sort(F.collect_list(F.struct("word", "text")))
    out = tokens.where(F.trim("text") != "").groupBy("doc_id", "page", "block", "par", "line").agg(
        F.array_join(F.transform(words_, lambda w: F.trim(w["text"])), " ").alias("text"), F.struct(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).alias("bbox"), F.round(F.avg("conf") / 100, 4).alias("confidence")
    )
    return out


def ocr_languages(preferred: Column, available: Column) -> Column:
    """Preferred languages that are available, else the first five available ones."""
    both = F.array_intersect(preferred, available)
    return F.when(F.size(both) > 0, both).otherwise(F.slice(available, 1, 5))
