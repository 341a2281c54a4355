"""Line formats (JSONL, CSV) cut by byte ranges: one large file runs on all cores and gives the rows of its parser.

Spark reads a text file in splits. A line's number is its place in its split plus the lines of the splits before it: a sum
over one row per split. What else goes from line to line is carried in the same way: for JSONL the number of lines that hold
something (a file's budget of blocks ends after as many lines at most), for CSV whether a line begins inside a quoted field.
A split doesn't know that, so it is summed up under both assumptions, as a map from state to state; the maps are applied in
order, and only records that a split's end cuts are put together by a shuffle.

Empty lines are counted. Bytes that are no UTF-8 are left out, as in the parsers. What carries over is one small row per split.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import written
from . import structured

#: Line ends beside those of the text source, as str.splitlines has them.
MORE_ENDS = "[\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
BLANK = "(?U)^[\\s\\x1c-\\x1f]*$"
BATCH = 10_000
#: Splits whose states are broadcast, some 100 bytes each; beyond, lines are joined with them by a sort.
MOST_SPLITS = 100_000


def split_lines(spark: SparkSession, paths: str | list[str], more_ends: bool = True) -> DataFrame:
    """(path, start, line): the lines of files in order within each split (path, start)."""
    at = (F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    rows = spark.read.option("recursiveFileLookup", "true").text(paths)
    if not more_ends:
        return rows.select(*at, F.col("value").alias("line"))
    parts = F.when(F.col("value").rlike(MORE_ENDS), F.split("value", MORE_ENDS, -1)).otherwise(F.array("value"))
    return rows.select(*at, F.explode(parts).alias("line"))


def offsets(counts: DataFrame, **sums: str) -> DataFrame:
    """One row per split (path, start) with, for each name, the sum of a column over the file's splits before it."""
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("path", "start", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name) for name, c in sums.items()])


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], pd.DataFrame, bool]]:
    """Batches cut into rows of one split each, in order, and whether the split begins with it."""
    last = None
    for b in frames:
        if not len(b):
            continue
        cut = (b["path"] != b["path"].shift()) | (b["start"] != b["start"].shift())
        for _, rows in b.groupby(cut.cumsum(), sort=False):
            split = (rows["path"].iloc[0], int(rows["start"].iloc[0]))
            yield split, rows, split != last
            last = split


def numbered(rows: DataFrame) -> DataFrame:
    """Add line_no and filled_no, from 1 over the whole file, to split_lines; filled_no counts the lines that hold something."""
    counts = rows.groupBy("path", "start").agg(F.count("*").alias("n"), F.count_if(~F.col("line").rlike(BLANK)).alias("filled"))
    before = offsets(counts, lines_before="n", filled_before="filled")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = filled = 0
        for _, part, new in _runs(frames):
            n, filled = (0, 0) if new else (n, filled)
            some = part["filled"].cumsum() + filled
            yield part.assign(line_no=range(n + 1, n + len(part) + 1), filled_no=some)
            n, filled = n + len(part), int(some.iloc[-1])

    rows = rows.withColumn("filled", (~F.col("line").rlike(BLANK)).cast("int")).withColumn("line", F.col("line").cast("binary"))
    local = rows.mapInPandas(run, "path string, start bigint, line binary, filled int, line_no bigint, filled_no bigint")
    out = local.join(before, ["path", "start"])
    return out.select("path", "line", (F.col("filled") == 1).alias("filled"), (F.col("line_no") + F.col("lines_before")).alias("line_no"), (F.col("filled_no") + F.col("filled_before")).alias("filled_no"))


def _record_blocks(number: int, data: bytes, limit: int | None) -> Iterator[structured.Row]:
    return islice(structured.line_rows(number, data.decode("utf-8", "ignore")), limit)


def jsonl_blocks(spark: SparkSession, paths: str | list[str], limit: int | None = structured.LIMIT) -> DataFrame:
    """(path, line, pos, type, text, attrs, confidence): the blocks of JSONL files, pos within the line.

    With a limit a file gives limit - 1 blocks and a marker if there were more, as its parser does: its first `limit` lines
    that hold something decide. Without one every line is parsed, in as many tasks as the file has splits.
    """
    rows = numbered(split_lines(spark, paths)).where("filled")
    if limit:
        rows = rows.where(F.col("filled_no") <= limit)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []

        def frame() -> pd.DataFrame:
            return pd.DataFrame(out, columns=["path", "line", "pos", "type", "text", "attrs", "confidence"])

        for b in frames:
            for path, line, data in zip(b["path"], b["line_no"], b["line"]):
                for k, row in enumerate(_record_blocks(line, data, limit)):
                    out.append((path, line, k, *row))
                    if len(out) >= BATCH:
                        yield frame()
                        out = []
        yield frame()

    blocks = rows.select("path", "line_no", "line").mapInPandas(run, "path string, line bigint, pos int, type string, text string, attrs map<string,string>, confidence double")
    if not limit:
        return blocks
    # at most `limit` lines of a file, with `limit` blocks each, meet here
    blocks = blocks.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("line", "pos"))).where(F.col("n") <= limit)
    kind, text, attrs, level = structured.truncation(limit)
    last = F.col("n") == limit
    said = F.create_map(*[F.lit(x) for kv in attrs.items() for x in kv])
    marker = {"type": F.lit(kind), "text": F.lit(text), "attrs": said, "confidence": F.lit(level)}
    return blocks.withColumns({c: F.when(last, v).otherwise(F.col(c)) for c, v in marker.items()}).drop("n")


def jsonl_metadata(spark: SparkSession, paths: str | list[str], sample: int = 50, keys: int = 5) -> DataFrame:
    """(path, lines, valid_in_sample, sample_keys): lines that hold something, and what the first `sample` of them are."""

    def read(lines: pd.Series) -> pd.Series:
        def one(data: bytes) -> list | None:
            try:
                value = json.loads(data.decode("utf-8", "replace"))
            except ValueError:
                return None
            return [json.dumps(sorted(value), ensure_ascii=False)] if isinstance(value, dict) else []

        return lines.map(one)

    rows = numbered(split_lines(spark, paths)).where("filled")
    counts = rows.groupBy("path").agg(F.count("*").alias("lines"))
    first = rows.where(F.col("filled_no") <= sample).select("path", "filled_no", F.pandas_udf(read, "array<string>")("line").alias("keys"))
    seen = F.array_sort(F.collect_list(F.when(F.size("keys") > 0, F.struct("filled_no", F.col("keys")[0].alias("k")))))
    shown = first.groupBy("path").agg(F.count("keys").alias("valid_in_sample"), F.slice(seen, 1, keys).alias("seen"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("seen", lambda s: s["k"]), ", "), F.lit("]"))
    return counts.join(shown, "path").select("path", "lines", "valid_in_sample", listed.alias("sample_keys"))


# CSV


def quote_state(line: str, inside: bool, sep: str = ",") -> bool:
    """Whether a quoted field is open after the line, by the csv module itself: an open field takes the next line, too."""
    if '"' not in line:
        return inside
    reader = csv.reader(iter([('"' if inside else "") + line + "\n", "\n"]), delimiter=sep)
    next(reader)
    return reader.line_num == 2


def _split_maps(rows: DataFrame, sep: str) -> DataFrame:
    """One row per split: for both states at its start, the state at its end and how many records begin in it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(1 << 30)
        now, state, begun = None, [False, True], [0, 0]

        def frame() -> pd.DataFrame:
            return pd.DataFrame([(*now, *state, *begun)], columns=["path", "start", "from_out", "from_in", "begun_out", "begun_in"])

        for split, part, new in _runs(frames):
            if new:
                if now:
                    yield frame()
                now, state, begun = split, [False, True], [0, 0]
            for data in part["line"]:
                line = data.decode("utf-8", "ignore")
                begun = [n + (not s) for n, s in zip(begun, state)]
                state = [quote_state(line, s, sep) for s in state] if state[0] != state[1] else [quote_state(line, state[0], sep)] * 2
        if now:
            yield frame()

    return rows.mapInPandas(run, "path string, start bigint, from_out boolean, from_in boolean, begun_out bigint, begun_in bigint")


def _starts(maps: DataFrame) -> DataFrame:
    """(path, start, inside, before): the state at each split's start and the records begun before it. One row per split is folded."""
    step = F.struct("start", "from_out", "from_in", "begun_out", "begun_in")
    files = maps.groupBy("path").agg(F.array_sort(F.collect_list(step)).alias("splits"))
    zero = F.array(F.struct(F.lit(-1).cast("bigint").alias("start"), F.lit(False).alias("inside"), F.lit(0).cast("bigint").alias("before"), F.lit(False).alias("next_inside"), F.lit(0).cast("bigint").alias("next_before")))

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        inside, before = last["next_inside"], last["next_before"]
        return F.concat(done, F.array(F.struct(s["start"].alias("start"), inside.alias("inside"), before.alias("before"), F.when(inside, s["from_in"]).otherwise(s["from_out"]).alias("next_inside"), (before + F.when(inside, s["begun_in"]).otherwise(s["begun_out"])).alias("next_before"))))

    walked = files.select("path", F.explode(F.aggregate("splits", zero, add)).alias("s")).where("s.start >= 0")
    return walked.select("path", "s.start", "s.inside", "s.before")


def _cells(text: str, sep: str) -> list[str]:
    return next(csv.reader(io.StringIO(text, newline=""), delimiter=sep), [])


def csv_records(spark: SparkSession, paths: str | list[str], sep: str = ",") -> DataFrame:
    """(path, record, cells): the records of CSV files, numbered from 1; an empty line is a record without cells.

    A record is put together where its lines are; only one that goes over the end of a split is shuffled, and its lines are
    held by one task (a quote that is never closed takes the rest of its file).
    """
    rows = split_lines(spark, paths, more_ends=False).withColumn("line", F.col("line").cast("binary"))
    maps = written(_split_maps(rows, sep))
    starts = _starts(maps)
    if maps.count() <= MOST_SPLITS:
        met = rows.join(F.broadcast(starts), ["path", "start"])  # lines stay in their order
    else:
        met = rows.withColumn("at", F.monotonically_increasing_id()).join(starts.hint("merge"), ["path", "start"]).sortWithinPartitions("path", "start", "at")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(1 << 30)
        now, inside, record, held, whole, out = None, False, 0, [], True, []

        def done(complete: bool) -> tuple:
            text = "\n".join(held)
            return (now[0], record, now[1], _cells(text, sep), None) if complete else (now[0], record, now[1], None, text)

        def frame() -> pd.DataFrame:
            return pd.DataFrame(out, columns=["path", "record", "start", "cells", "part"])

        for split, part, new in _runs(frames):
            if new:
                if held:  # the split before this one ends within a record
                    out.append(done(False))
                now, inside, record, held = split, bool(part["inside"].iloc[0]), int(part["before"].iloc[0]), []
                whole = not inside
            for data in part["line"]:
                line = data.decode("utf-8", "ignore")
                if not inside:
                    record, whole = record + 1, True
                held.append(line)
                inside = quote_state(line, inside, sep)
                if not inside:
                    out.append(done(whole))
                    held = []
                if len(out) >= BATCH:
                    yield frame()
                    out = []
        if held:
            out.append(done(False))
        yield frame()

    schema = "path string, record bigint, start bigint, cells array<string>, part string"
    found = met.select("path", "start", "line", "inside", "before").mapInPandas(run, schema)

    def parse(texts: pd.Series) -> pd.Series:
        csv.field_size_limit(1 << 30)
        return texts.map(lambda t: _cells(t, sep))

    cut = found.where("part is not null").groupBy("path", "record").agg(F.array_sort(F.collect_list(F.struct("start", "part"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["part"]), "\n")
    joined = cut.select("path", "record", F.pandas_udf(parse, "array<string>")(text).alias("cells"))
    return found.where("cells is not null").select("path", "record", "cells").unionByName(joined)


def csv_tables(records: DataFrame, rows: int | None = None) -> DataFrame:
    """(path, part, text, attrs): tables of csv_records, as the parser gives them; one per file, or one per so many records."""

    def as_json(cells: pd.Series) -> pd.Series:
        return cells.map(lambda c: json.dumps(list(c), ensure_ascii=False))

    part = F.floor((F.col("record") - 1) / rows).cast("int") if rows else F.lit(0)
    row = F.struct("record", F.array_join("cells", ", ").alias("text"), F.pandas_udf(as_json, "string")("cells").alias("json"))
    held = records.select("path", part.alias("part"), row.alias("row")).groupBy("path", "part").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    shown = F.array_join(F.transform("rows", lambda r: r["text"]), "\n")
    listed = F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["json"]), ", "), F.lit("]"))
    return held.select("path", "part", shown.alias("text"), F.create_map(F.lit("rows"), listed).alias("attrs"))
