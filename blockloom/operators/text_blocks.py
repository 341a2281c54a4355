"""Pieces to blocks: paragraphs, tables, chunks of bounded length, types and attributes, for all formats at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.segment import attributes, classify, confidence, paragraphs, short_lines, shatter, strip
from ..schema import once
from ..sources.tables import detect


def refine_pieces(pieces: DataFrame) -> DataFrame:
    """Blocks (doc_id, pos, type, text, attrs, source, confidence, page) of parsers.PIECE or RUNS rows; pos runs over a document.

    Order is carried as (piece, paragraph, chunk) and turned into pos by one window per document. A run of finished blocks
    stays one row up to there: it is counted by its length, and its blocks are rows of their own only then.
    """
    none = F.create_map().cast("map<string,string>")
    rows = pieces.withColumn("attrs", F.coalesce("attrs", none))
    parts = F.when(F.col("mode") == "text", paragraphs(F.coalesce("text", F.lit("")))).otherwise(F.array("text"))
    rows = rows.select(*[c for c in rows.columns if c != "text"], F.posexplode_outer(parts).alias("part", "text"))
    is_text = F.col("mode") == "text"
    rows = rows.withColumn("_t", detect(F.when(is_text, F.col("text"))))
    cut = F.when(is_text & F.col("_t").isNull(), F.flatten(F.transform(short_lines(F.col("text")), shatter))).when(F.col("mode").isin("block", "run"), F.array("text")).otherwise(shatter(F.col("text")))
    # a paragraph that stays whole is not searched for a table again
    rows = once(rows, _cut=cut)
    same = is_text & (F.size("_cut") == 1) & (F.get("_cut", F.lit(0)) == F.col("text"))
    rows = rows.withColumn("_same", F.coalesce(same, F.lit(False))).withColumn("_t", F.when(F.col("_same"), F.col("_t")))
    rows = rows.select(*[c for c in rows.columns if c not in ("text", "_cut")], F.posexplode_outer("_cut").alias("chunk", "text"))
    done = F.col("mode").isin("block", "run")
    rows = once(rows, text=F.when(done, F.col("text")).otherwise(strip(F.coalesce("text", F.lit("")))))
    # an empty text file keeps one row, of type other
    rows = rows.where(done | (F.col("text") != "") | (is_text & F.col("part").isNull()))
    tabular = is_text & F.contains("text", F.lit("\n")) & F.try_element_at("attrs", F.lit("_no_table")).isNull()
    rows = rows.withColumn("_f", F.when(tabular & F.col("_same"), F.col("_t")).otherwise(detect(F.when(tabular & ~F.col("_same"), F.col("text")))))
    found = F.col("_f").isNotNull()
    kind = F.when(done, F.col("type")).when(found, "table").otherwise(classify(F.col("text")))
    rows = once(rows, _k=kind)
    heading = F.try_element_at("attrs", F.lit("_heading")).isNotNull() & (F.col("_k") == "paragraph")
    rows = rows.withColumn("type", F.when(heading, "heading").otherwise(F.col("_k")))
    table_attrs = F.create_map(
        F.lit("rows"), F.to_json("_f.rows"), F.lit("delimiter"), F.col("_f.delimiter"), F.lit("structured_from"), F.lit("text_table"), F.lit("row_count"), F.size("_f.rows").cast("string"), F.lit("column_count"), F.size(F.get(F.col("_f.rows"), F.lit(0))).cast("string")
    )
    own = F.map_filter("attrs", lambda k, _: ~k.startswith("_"))
    attrs = F.when(done, own).when(found, F.map_concat(own, table_attrs)).otherwise(F.map_concat(F.map_filter(own, lambda k, _: ~k.isin("key", "value", "timestamp", "message")), attributes(F.col("_k"), F.col("text"))))
    level = F.when(done, F.col("confidence")).when(found, F.when(F.col("_f.delimiter") == "whitespace", 0.74).otherwise(0.78)).otherwise(F.greatest(confidence(F.col("_k")), F.coalesce("confidence", F.lit(0.0))))
    shown = F.when(found, F.array_join(F.transform("_f.rows", lambda r: F.array_join(r, ", ")), "\n")).otherwise(F.col("text"))
    rows = once(rows, attrs=attrs, confidence=level, text=shown)
    order = Window.partitionBy("doc_id").orderBy("piece", "part", "chunk")
    if "blocks" not in pieces.columns:
        return rows.select("doc_id", (F.row_number().over(order) - 1).alias("pos"), "type", "text", "attrs", "source", "confidence", "page", "parse_error")
    run = F.col("mode") == "run"
    n = F.when(run, F.size("blocks")).otherwise(1)
    rows = rows.withColumn("_before", F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - n)
    rows = rows.select(*[c for c in rows.columns if c != "blocks"], F.posexplode_outer(F.when(run, F.col("blocks"))).alias("_i", "_b"))
    shown_attrs = F.map_filter("_b.attrs", lambda k, _: ~k.startswith("_"))
    either = {c: F.when(run, shown_attrs if c == "attrs" else F.col(f"_b.{c}")).otherwise(F.col(c)).alias(c) for c in ("type", "text", "attrs", "confidence", "page")}
    pos = (F.col("_before") + F.coalesce("_i", F.lit(0))).cast("int").alias("pos")
    return rows.select("doc_id", pos, either["type"], either["text"], either["attrs"], "source", either["confidence"], either["page"], "parse_error")


def spread(rows: DataFrame) -> DataFrame:
    """rows in as many partitions as there are cores, if the input has fewer (one small file); else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.isStreaming or rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def text_blocks(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Blocks of plain texts that are already in a table (key, text)."""
    pieces = spread(docs.select(key, text)).select(
        F.col(key).cast("bigint").alias("doc_id"),
        F.lit(None).cast("string").alias("source"),
        F.lit(0).alias("piece"),
        F.lit("text").alias("mode"),
        F.lit(None).cast("string").alias("type"),
        F.col(text).alias("text"),
        F.create_map().cast("map<string,string>").alias("attrs"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit(None).cast("int").alias("page"),
        F.lit(None).cast("string").alias("parse_error"),
    )
    return refine_pieces(pieces)
