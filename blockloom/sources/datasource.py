"""Files and their parsed pieces as Spark data sources: planned by bytes, with filters and columns pushed to the files.

    register(spark)
    spark.read.format("blockloom_files").option("glob", "*.md").load("/data/in").where("type = 'md' and size < 100000")
    spark.read.format("blockloom_pieces").option("parser.log", "mine.formats:parse_log").load("/data/in")

The reader lists files, drops those that filters on path, size, type and MIME type rule out, and packs the rest into
partitions of at most `partitionBytes`. A dropped file is never opened; one beyond `maxBytes` is a row with an error and is
not opened either. Names that start with _ or . are left out, as Spark does, unless `hidden` is true. Content is read only if the schema asks for it (`columns`), and handed on in batches of some megabytes.
Files are reached through pyarrow's file systems (local paths, and the URIs it knows).
"""

from __future__ import annotations

import fnmatch
import importlib
import json
import mimetypes
import posixpath
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .files import MIME_OF, MOST_BYTES, TYPE_OF
from .parsers import BY_MIME, PARSERS, PIECE, parse_text

FILES = "path string, size bigint, modified_at timestamp, type string, mime string, error string, content binary"
#: Bytes of a partition, what opening a file counts as, and the bytes of content in one batch.
PARTITION_BYTES, OPEN_BYTES, BATCH_BYTES = 128 << 20, 1 << 20, 16 << 20
HEAD = 5


def _table(of: dict[str, str]) -> dict[str, str]:
    return {x: value for value, names in of.items() for name in names.split() for x in (name, value)}


_TYPES, _MIMES = _table(TYPE_OF), _table(MIME_OF)


def suffix_of(path: str) -> str:
    found = re.search(r"[^/]\.([^./]*)$", path)
    return found[1].lower() if found else ""


def type_of(path: str, head: bytes = b"") -> str:
    """As files.detect_type."""
    end = suffix_of(path)
    if head[:5] == b"%PDF-":
        return "pdf"
    return end if head[:4] == b"PK\3\4" and end in ("docx", "xlsx", "pptx") else _TYPES.get(end, "text")


def mime_of(path: str) -> str:
    """As files.guess_mime."""
    mimetypes.init()
    end = suffix_of(path)
    return _MIMES.get(end) or mimetypes.types_map.get(f".{end}") or "application/octet-stream"


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """File system and its own path for a local path or a URI."""
    if path.startswith("file:"):
        path = re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Found(InputPartition):
    """The files of one task: path, size and time of each."""

    files: list[tuple[str, int, object]]


#: What a pushed filter means, by its class.
_TESTS = {
    EqualTo: lambda f, x: x == f.value,
    EqualNullSafe: lambda f, x: x == f.value,
    In: lambda f, x: x in f.value,
    GreaterThan: lambda f, x: x > f.value,
    GreaterThanOrEqual: lambda f, x: x >= f.value,
    LessThan: lambda f, x: x < f.value,
    LessThanOrEqual: lambda f, x: x <= f.value,
    StringStartsWith: lambda f, x: x.startswith(f.value),
    StringEndsWith: lambda f, x: x.endswith(f.value),
    StringContains: lambda f, x: f.value in x,
    IsNotNull: lambda f, x: True,
}
PUSHED = ("path", "size", "type", "mime")


def column_of(f: Filter) -> str | None:
    """The column that a filter which can be pushed is about."""
    inner = f.child if isinstance(f, Not) else f
    name = getattr(inner, "attribute", (None,))
    return name[0] if type(inner) in _TESTS and len(name) == 1 and name[0] in PUSHED else None


def passes(f: Filter, value: object) -> bool:
    return not passes(f.child, value) if isinstance(f, Not) else _TESTS[type(f)](f, value)


class FileReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.schema, self.names = schema, schema.names
        given = options.get("paths") or json.dumps([options["path"]])
        self.paths = json.loads(given)
        self.recursive = options.get("recursive", "true") == "true"
        self.glob, self.ignore = options.get("glob"), options.get("ignore")
        self.hidden = options.get("hidden", "false") == "true"
        self.most = int(options.get("maxbytes", MOST_BYTES))
        self.part_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.filters: list[tuple[str, Filter]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if name := column_of(f):
                self.filters.append((name, f))
            else:
                yield f

    def wanted(self, **values: object) -> bool:
        """Whether a file with these values may be a row; values that are not known yet don't count."""
        return all(passes(f, values[name]) for name, f in self.filters if name in values)

    def listed(self) -> Iterator[tuple[str, int, object]]:
        for given in self.paths:
            system, path = open_fs(given)
            start = given[: len(given) - len(path)] if "://" in given else ""
            info = system.get_file_info(path)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(given)
            found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=self.recursive))
            for x in found:
                if x.type == fs.FileType.File:
                    yield start + x.path, x.size, x.mtime

    def chosen(self) -> list[tuple[str, int, object]]:
        """Files that can be rows, in order of their paths. What the suffix can't tell (PDFs go by their first bytes) stays in."""
        out = {}
        for path, size, time in self.listed():
            name = posixpath.basename(path)
            if name[:1] in ("_", ".") and not self.hidden:
                continue
            if (self.glob and not fnmatch.fnmatch(name, self.glob)) or (self.ignore and fnmatch.fnmatch(path, self.ignore)):
                continue
            if self.wanted(path=path, size=size, mime=mime_of(path)) and (self.wanted(type=type_of(path)) or (size <= self.most and self.wanted(type="pdf"))):
                out[path] = (path, size, time)
        return [out[p] for p in sorted(out)]

    def partitions(self) -> list[InputPartition]:
        parts, held, weight = [], [], 0
        opens = self.reads()
        for f in self.chosen():
            cost = OPEN_BYTES + (f[1] if opens and f[1] <= self.most else 0)
            if held and weight + cost > self.part_bytes:
                parts.append(Found(held))
                held, weight = [], 0
            held.append(f)
            weight += cost
        return [*parts, Found(held)] if held or not parts else parts

    def reads(self) -> bool:
        """Whether rows need the files' content."""
        return "content" in self.names

    def opened(self, path: str, size: int | None = None) -> bytes:
        system, own = open_fs(path)
        with system.open_input_stream(own) as f:
            return f.read() if size is None else f.read(size)

    def found(self, part: Found) -> Iterator[tuple[str, int, object, str, bytes | None, str | None]]:
        """path, size, time, type, content and error of the files that are rows."""
        filtered = any(name == "type" for name, _ in self.filters)
        for path, size, time in part.files:
            if size > self.most:
                yield path, size, time, type_of(path), None, "file too large"
                continue
            data, kind, error = None, type_of(path), None
            try:
                if filtered or ("type" in self.names and not self.reads()):
                    kind = type_of(path, self.opened(path, HEAD))
                    if not self.wanted(type=kind):
                        continue
                if self.reads():
                    data = self.opened(path)
                    kind = type_of(path, data[:HEAD])
            except OSError as e:
                data, error = None, f"{type(e).__name__}: {e}"
            yield path, size, time, kind, data, error

    def read(self, partition: Found) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        rows: list[dict] = []
        held = 0
        for path, size, time, kind, data, error in self.found(partition):
            rows.append({"path": path, "size": size, "modified_at": time, "type": kind, "mime": mime_of(path), "error": error, "content": data})
            held += OPEN_BYTES // 64 + len(data or b"")
            if held > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in self.names} for r in rows], schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in self.names} for r in rows], schema)


class PieceReader(FileReader):
    """Pieces (parsers.PIECE without doc_id) of each file. A file that its parser can't read is read as text, with parse_error."""

    def __init__(self, options: dict[str, str], schema: StructType):
        super().__init__(options, schema)
        self.parsers = {k.removeprefix("parser."): v for k, v in options.items() if k.startswith("parser.")}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """The column source is the file's path; type is a piece's, not a file's."""
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            if type(inner) in _TESTS and inner.attribute == ("source",):
                self.filters.append(("path", f))
            else:
                yield f

    def reads(self) -> bool:
        return True

    def parser(self, path: str, kind: str):
        mime = mime_of(path)
        for name in (mime, suffix_of(path), kind):
            if name in self.parsers:
                module, function = self.parsers[name].split(":")
                return getattr(importlib.import_module(module), function)
        return PARSERS.get(BY_MIME.get(mime) or kind, parse_text)

    def read(self, partition: Found) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        rows: list[dict] = []
        held = 0
        for path, _, _, kind, data, error in self.found(partition):
            pieces, failed = [], error
            if data is not None:
                try:
                    pieces = list(self.parser(path, kind)(data))
                    if not pieces:
                        raise ValueError("no blocks")
                except Exception as e:  # noqa: BLE001  any broken file falls back to plain text
                    pieces, failed = list(parse_text(data)), f"{type(e).__name__}: {e}"
            elif error:
                pieces = [("block", "other", "", {}, 0.0, None)]
            for k, (mode, sort, text, attrs, level, page) in enumerate(pieces):
                row = {"source": path, "piece": k, "mode": mode, "type": sort, "text": text, "attrs": list(attrs.items()), "confidence": level, "page": page, "parse_error": failed}
                rows.append({n: row[n] for n in self.names})
                held += len(text) + 64
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class FileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blockloom_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: StructType) -> FileReader:
        return FileReader({k.lower(): v for k, v in self.options.items()}, schema)


class PieceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blockloom_pieces"

    def schema(self) -> str:
        return PIECE.removeprefix("doc_id bigint, ")

    def reader(self, schema: StructType) -> PieceReader:
        return PieceReader({k.lower(): v for k, v in self.options.items()}, schema)


def register(spark: SparkSession) -> None:
    """Make both sources known to a session, and let it push filters to them."""
    spark.dataSource.register(FileSource)
    spark.dataSource.register(PieceSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _reader(spark: SparkSession, name: str, paths: str | list[str], options: dict):
    register(spark)
    reader = spark.read.format(name).option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths)))
    for k, v in options.items():
        if v is not None:
            reader = reader.option(k, str(v).lower() if isinstance(v, bool) else v)
    return reader


def planned_scan(spark: SparkSession, paths: str | list[str], columns: Iterable[str] | None = None, **options) -> DataFrame:
    """Rows of files.scan by the planned source, with doc_id. columns: those to be read; without content nothing is opened that needs not be."""
    kinds = dict(c.split() for c in FILES.split(", "))
    names = list(columns or kinds)
    rows = _reader(spark, "blockloom_files", paths, options).schema(", ".join(f"{n} {kinds[n]}" for n in names)).load()
    return rows.withColumn("doc_id", F.xxhash64("path")) if "path" in names else rows


def planned_pieces(spark: SparkSession, paths: str | list[str], parsers: dict[str, str] | None = None, **options) -> DataFrame:
    """PIECE rows of files. parsers: further ones by type, suffix or MIME type, as `module:function`."""
    more = {f"parser.{k}": v for k, v in (parsers or {}).items()}
    rows = _reader(spark, "blockloom_pieces", paths, options | more).load()
    return rows.select(F.xxhash64("source").alias("doc_id"), "*")
