"""File scans: paths, type and MIME routing, size guards, raw text."""

from __future__ import annotations

import fnmatch
import mimetypes
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.segment import newlines

# fixed values: types and MIME types by file name
TYPE_OF = {
    "text": "txt log rst xml rtf",
    "md": "md markdown",
    "csv": "csv tsv",
    "json": "json",
    "jsonl": "jsonl ndjson",
    "html": "html htm",
    "pdf": "pdf",
    "docx": "docx",
    "xlsx": "xlsx",
    "pptx": "pptx",
    "ini": "ini cfg conf properties",
    "yaml": "yaml yml",
    "toml": "toml",
    "eml": "eml",
    "ics": "ics",
    "image": "png jpg jpeg tif tiff bmp gif webp",
}
MIME_OF = {
    "application/json": "json",
    "application/x-ndjson": "jsonl ndjson",
    "text/markdown": "md markdown",
    "text/plain": "txt log",
    "application/yaml": "yaml yml",
    "application/xml": "xml",
    "text/rtf": "rtf",
    "message/rfc822": "eml",
    "application/toml": "toml",
    "text/csv": "csv",
    "text/tab-separated-values": "tsv",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "text/calendar": "ics",
    "application/pdf": "pdf",
    "text/html": "html htm",
    "image/png": "png",
    "image/jpeg": "jpg jpeg",
    "image/tiff": "tif tiff",
    "image/bmp": "bmp",
    "image/gif": "gif",
    "image/webp": "webp",
}
MOST_BYTES, MOST_PAYLOAD_BYTES = 200 << 20, 500 << 20


def _lookup(c: Column, table: dict[str, str]) -> Column:
    flat = [F.lit(x) for value, names in table.items() for name in names.split() for x in (name, value)]
    return F.try_element_at(F.create_map(*flat), c)


def suffix(path: Column) -> Column:
    """Lower-case suffix without its dot; '' where the last part of the path has none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def detect_type(path: Column, head: Column | None = None) -> Column:
    """Type by magic bytes (PDF; zip with an Office suffix), else by suffix, else text."""
    end = suffix(path)
    by_name = F.coalesce(_lookup(end, TYPE_OF), F.lit("text"))
    if head is None:
        return by_name
    return F.when(F.hex(F.substring(head, 1, 5)) == "255044462D", "pdf").when((F.hex(F.substring(head, 1, 4)) == "504B0304") & end.isin("docx", "xlsx", "pptx"), end).otherwise(by_name)


def guess_mime(path: Column) -> Column:
    """MIME type by suffix; beyond the fixed table the standard library's, else application/octet-stream."""
    mimetypes.init()
    known = {n for names in MIME_OF.values() for n in names.split()}
    more: dict[str, str] = {}
    for end, mime in mimetypes.types_map.items():
        if end[1:] not in known and " " not in end:
            more[mime] = f"{more.get(mime, '')} {end[1:]}"
    end = suffix(path)
    return F.coalesce(_lookup(end, MIME_OF), _lookup(end, more), F.lit("application/octet-stream"))


def expand_paths(paths: Iterable[str], recursive: bool = True) -> list[str]:
    """Sorted files below local paths, each once, in the order of the paths given."""
    out: dict[str, None] = {}
    for p in map(Path, paths):
        found = [p] if p.is_file() else sorted(x for x in (p.rglob("*") if recursive else p.glob("*")) if x.is_file())
        out.update(dict.fromkeys(map(str, found)))
    return list(out)


def refused(paths: Iterable[str], most_bytes: int = MOST_BYTES) -> dict[str, str]:
    """Why local paths can't be read as files: missing, not a file, or too large (MOST_PAYLOAD_BYTES is the payloads' bound)."""
    out = {}
    for p in map(Path, paths):
        if not p.exists():
            out[str(p)] = "file not found"
        elif not p.is_file():
            out[str(p)] = "not a file"
        elif p.stat().st_size > most_bytes:
            out[str(p)] = "file too large"
    return out


def load_path_entries(file: str) -> list[str]:
    """Paths listed in a file; blank lines and # comments are skipped, repeats dropped."""
    rows = (x.strip() for x in Path(file).read_text(encoding="utf-8").splitlines())
    return list(dict.fromkeys(x for x in rows if x and not x.startswith("#")))


def without_glob(df: DataFrame, glob: str, path: str = "path") -> DataFrame:
    """Rows whose path does not match a shell pattern."""
    pattern = re.sub(r"^\(\?s:(.*)\)\\[zZ]$", r"(?s)^(?:\1)$", fnmatch.translate(glob))
    return df.where(~F.col(path).rlike(pattern))


BINARY = "path string, modificationTime timestamp, length long, content binary"


def described(rows: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows of the source binaryFile (BINARY) as scan gives them.

    The filter on length is pushed and the content pruned, so a file that is too large is not read, as it couldn't be beyond 2 GB.
    """

    def named(part: DataFrame, content: Column, error: Column) -> DataFrame:
        kind = detect_type(F.col("path"), content)
        stamp = F.col("modificationTime").alias("modified_at")
        return part.select("path", F.col("length").alias("size"), stamp, content.alias("content"), kind.alias("type"), guess_mime(F.col("path")).alias("mime"), F.xxhash64("path").alias("doc_id"), error.alias("error"))

    none = F.lit(None)
    small = named(rows.where(F.col("length") <= most_bytes), F.col("content"), none.cast("string"))
    return small.unionByName(named(rows.where(F.col("length") > most_bytes), none.cast("binary"), F.lit("file too large")))


def scan(spark: SparkSession, paths: str | list[str], recursive: bool = True, glob: str | None = None, ignore: str | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per file: path, size, modified_at, content, type, mime, doc_id, error (null, or why a file is not read)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    out = described(reader.load(paths), most_bytes)
    return without_glob(out, ignore) if ignore else out


def decoded(content: Column) -> Column:
    """Struct (text, encoding): UTF-8 if valid (a byte-order mark is cut), else UTF-16 by its mark, cp932, shift_jis, latin-1."""

    def ladder(data: bytes) -> tuple[str, str]:
        tries = ["utf-16"] if data[:2] in (b"\xff\xfe", b"\xfe\xff") else []
        for name in [*tries, "cp932", "shift_jis"]:
            try:
                return data.decode(name), name
            except UnicodeDecodeError:
                pass
        return data.decode("latin-1"), "latin-1"

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([(None, None) if d is None else ladder(bytes(d)) for d in p], columns=["text", "encoding"])

    text = F.try_validate_utf8(content.cast("string"))
    other = F.pandas_udf(run, "text string, encoding string")(F.when(text.isNull(), content))
    marked = text.startswith("﻿")
    return F.when(text.isNotNull(), F.struct(F.regexp_replace(text, "^﻿", "").alias("text"), F.when(marked, "utf-8-sig").otherwise("utf-8").alias("encoding"))).otherwise(other)


def texts(files: DataFrame) -> DataFrame:
    """Add text (LF line ends) and encoding to scanned files."""
    return files.withColumn("_d", decoded(F.col("content"))).withColumn("text", newlines(F.col("_d.text"))).withColumn("encoding", F.col("_d.encoding")).drop("_d")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A JSONL dataset for replay: pos, record (id, prompt, metadata), error. Blank lines are skipped.

    The prompt is the first of prompt, text, input and content that is not empty; it must not be blank.
    """
    rows = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id()).where(F.trim("value") != "")
    data = F.from_json("value", "id string, prompt string, text string, input string, content string, metadata map<string,string>, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    out = rows.withColumn("d", data)
    prompt = F.coalesce(*[F.nullif(f"d.{k}", F.lit("")) for k in ("prompt", "text", "input", "content")])
    error = F.when(F.col("d._corrupt").isNotNull(), "invalid JSON").when(prompt.isNull() | (F.trim(prompt) == ""), "no prompt")
    return out.select("pos", F.col("d.id").alias("id"), prompt.alias("prompt"), F.col("d.metadata").alias("metadata"), error.alias("error"))
