"""Schemas of the block and document tables, and the guards that rows must meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"
SPANS = "array<struct<start:int,end:int,label:string>>"
#: The central table: one row per block. doc_id and pos identify a block; physical order never matters.
BLOCK = f"doc_id bigint, pos int, type string, text string, attrs map<string,string>, source string, confidence double, lang string, page int, prov_order int, bbox {BBOX}, spans {SPANS}"

# fixed values: block types
TYPES = ("paragraph", "heading", "header", "title", "list_item", "list", "table", "figure", "code", "footnote", "metadata", "meta", "kv", "log", "event", "attachment", "other")


def block_id(doc_id: Column | str = "doc_id", pos: Column | str = "pos") -> Column:
    """A stable identifier of a block, the same on every run."""
    return F.sha2(F.concat_ws("|", doc_id, pos), 256)


def once(df: DataFrame, **values: Column) -> DataFrame:
    """df with columns that are evaluated once a row, however often they are used: projections aren't merged across a Generate."""
    found = F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()])))
    kept = [c for c in df.columns if c not in values]
    return df.select(*kept, found.alias("_once")).select(*[F.col(f"_once.{c}").alias(c) if c in values else c for c in df.columns], *[f"_once.{k}" for k in values if k not in df.columns])


def violations(blocks: DataFrame) -> DataFrame:
    """Add `violations`: the guards a row breaks (box order, span order, span inside text, confidence, type)."""
    have = set(blocks.columns)
    checks = [(F.lit("confidence"), ~F.col("confidence").between(0, 1)), (F.lit("type"), ~F.col("type").isin(*TYPES))]
    if "bbox" in have:
        checks.append((F.lit("bbox"), (F.col("bbox.x1") < F.col("bbox.x0")) | (F.col("bbox.y1") < F.col("bbox.y0"))))
    if "spans" in have:
        checks.append((F.lit("span order"), F.exists("spans", lambda s: s["end"] < s["start"])))
        checks.append((F.lit("span bounds"), F.exists("spans", lambda s: (s["start"] < 0) | (s["end"] > F.length("text")))))
    if "uri" in have:
        checks.append((F.lit("source"), F.col("source") != F.col("uri")))
    return blocks.withColumn("violations", F.array_compact(F.array(*[F.when(bad, name) for name, bad in checks])))


def quarantine(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that meet the guards, rows that do not)."""
    checked = violations(blocks)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)
