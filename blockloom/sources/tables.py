"""Tables in plain text: rows that one delimiter cuts into equally many cells."""

from __future__ import annotations

import csv
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.segment import full_lines

# fixed values: delimiters in the order they are tried
DELIMITERS = (("comma", ","), ("tab", "\t"), ("semicolon", ";"), ("pipe", "|"), ("whitespace", None))
DIVIDER = re.compile(r":?-{3,}:?")

FOUND = "struct<delimiter:string,rows:array<array<string>>>"


def cells(line: str, delimiter: str | None) -> list[str]:
    """Cells of a line, trimmed. None: cut at two or more spaces. A pipe row loses empty cells at its ends."""
    if delimiter is None:
        return [c for c in (x.strip() for x in re.split(r"\s{2,}", line.strip())) if c]
    try:
        row = [c.strip() for c in next(csv.reader([line], delimiter=delimiter), [])]
    except csv.Error:
        return []
    if delimiter == "|":
        filled = [k for k, c in enumerate(row) if c]
        row = row[filled[0] : filled[-1] + 1] if filled else []
    return row


def table(lines: list[str]) -> tuple[str, list[list[str]]] | None:
    """(delimiter, rows) of the delimiter that covers most lines, then gives most columns, the first of equals; None if none.

    The width is the most frequent one among rows of two or more cells (the first seen of equals); longer rows are cut,
    shorter ones dropped, as are divider rows. All lines but one, and two at least, must remain.
    """
    best: tuple[tuple[int, int], str, list[list[str]]] | None = None
    for name, delimiter in DELIMITERS if len(lines) > 1 else ():
        rows = [r for r in (cells(x, delimiter) for x in lines) if len(r) > 1]
        if len(rows) < 2:
            continue
        width = Counter(map(len, rows)).most_common(1)[0][0]
        kept = [r[:width] for r in rows if len(r) >= width]
        kept = [r for r in kept if not all(DIVIDER.fullmatch(c) for c in r)]
        if len(kept) >= max(2, len(lines) - 1) and (best is None or (len(kept), width) > best[0]):
            best = (len(kept), width), name, kept
    return best and best[1:]


def promising(rows: Column) -> Column:
    """Whether some delimiter stands in enough lines for a table: what most prose fails, so that it is not parsed."""
    least = F.greatest(F.lit(2), F.size(rows) - 1)

    def having(holds: Callable[[Column], Column]) -> Column:
        return F.size(F.filter(rows, holds)) >= least

    def containing(delimiter: str) -> Column:
        return having(lambda x: F.contains(x, F.lit(delimiter)))

    out = having(lambda x: x.rlike(r"(?U)\S[\s\x1c-\x1f]{2,}\S"))
    for _, delimiter in DELIMITERS:
        out = out | containing(delimiter) if delimiter else out
    return out


def detect(c: Column) -> Column:
    """FOUND for a chunk's lines that are not blank, or null. CSV quoting needs a parser, so this goes through Arrow batches."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            out = [None if x is None else table(list(x)) for x in p]
            yield pd.Series([None if t is None else json.dumps(t, ensure_ascii=False) for t in out], dtype=object)

    rows = full_lines(c)
    # the lines are cut once, in an array of one, however often they are looked at
    good = F.get(F.transform(F.array(rows), lambda r: F.when((F.size(r) > 1) & promising(r), r)), F.lit(0))
    found = F.pandas_udf(run, "string")(good)
    return F.when(found.isNotNull(), F.struct(F.get_json_object(found, "$[0]").alias("delimiter"), F.from_json(F.get_json_object(found, "$[1]"), "array<array<string>>").alias("rows")))
