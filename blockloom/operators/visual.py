"""Blocks of images and of pages, through the layout: boxes, labels, confidences and reading order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import images, payloads
from . import layout

#: A recognised word: page, block, par, line, word, text, x0, y0, x1, y1, conf (0 to 100).
Token = tuple[int, int, int, int, int, str, float, float, float, float, float]
TOKEN = "page int, block int, par int, line int, word int, text string, x0 double, y0 double, x1 double, y1 double, conf double"

# fixed values: blocks of an image at most, confidences, and boxes of what has none
LIMIT = 400
SUMMARY, SAID, NOTHING, MARKER, LEAST_PAGE = 0.45, 0.6, 0.35, 0.4, 0.55

BLOCKS = "doc_id bigint, source string, type string, text string, attrs map<string,string>, confidence double, page int, place int"


def page_layout(blocks: DataFrame) -> DataFrame:
    """Blocks of pages (doc_id, pos, page, type, text, attrs, confidence) with boxes, labels and reading order.

    A page gives no boxes with its text, so each block gets one below the one before it, as large as its text is long. The
    threshold that a page settles at is the next page's start. Only windows by document and page.
    """
    order = Window.partitionBy("doc_id", "page").orderBy("pos")
    n = F.length("text")
    rows = blocks.withColumn("order_hint", F.row_number().over(order) - 1)
    tall, wide = F.least(F.lit(160.0), 24 + n * 0.12), F.least(F.lit(640.0), 120 + n * 0.9)
    top = F.col("order_hint") * (tall + 6)
    rows = rows.withColumn("bbox", F.struct(F.lit(36.0).alias("x0"), top.alias("y0"), (36 + wide).alias("x1"), (top + tall).alias("y1")))
    rows = rows.withColumn("confidence", F.greatest("confidence", F.lit(LEAST_PAGE)))
    rows = rows.withColumn("score", F.greatest("confidence", F.least(F.lit(0.95), 0.35 + n / 600)))
    own = F.coalesce("attrs", F.create_map().cast("map<string,string>"))
    page = F.create_map(F.lit("page"), (F.col("page") + 1).cast("string"), F.lit("layout_source"), F.lit("pdf"))
    rows = rows.withColumn("attrs", F.map_concat(F.map_filter(own, lambda k, _: ~k.isin("page", "layout_source")), page))
    done = layout.merge(layout.process(rows, section="page"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "batch", "order")) - 1
    return done.withColumn("pos", place).drop("order_hint", "score", "x0", "y0", "x1", "y1", "batch", "threshold", "order", "label", "layout_confidence", "x_center", "y_center")


def image_blocks(files: DataFrame, recognise: Callable[[bytes], list[Token]] | None = None, languages: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Blocks (doc_id, pos, type, text, attrs, confidence, page, bbox) of images (doc_id, path, content).

    A summary, the texts that the image carries, and the lines of the words that `recognise` finds, in the order that the
    layout gives them; `limit` - 1 at most and then a marker. An image without any of them gives one block that says so.
    """

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows, tokens = [], []
            for doc_id, path, content in zip(p["doc_id"], p["path"], p["content"]):
                meta, said = images.describe(bytes(content or b""))
                found = recognise(bytes(content or b"")) if recognise else []
                if meta:
                    rows.append((doc_id, path, "metadata", "Image summary", meta, SUMMARY, None, -2))
                for key, text, where in said:
                    rows.append((doc_id, path, "metadata", text, {"image_source": where, "length": str(len(text)), "key": key}, SAID, None, -1))
                if not rows or rows[-1][0] != doc_id:
                    rows.append((doc_id, path, "metadata", "Image contained no extractable text", {"image_has_text": "false"}, NOTHING, None, 0))
                tokens.append([dict(zip([f.split()[0] for f in TOKEN.split(", ")], t)) for t in found])
            out = pd.DataFrame(rows, columns=[f.split()[0] for f in BLOCKS.replace("map<string,string>", "map").split(", ")]).astype({"page": "Int32"})
            out["tokens"] = None
            yield out
            words = [(d, s, t) for d, s, t in zip(p["doc_id"], p["path"], tokens) if t]
            more = pd.DataFrame([(d, s, None, None, None, None, None, None, t) for d, s, t in words], columns=[*out.columns]).astype({"page": "Int32", "place": "Int32"})
            yield more

    found = files.select("doc_id", "path", "content").mapInPandas(read, BLOCKS + f", tokens array<struct<{TOKEN.replace(' ', ':').replace(',:', ',')}>>")
    words = found.where("tokens is not null").select("doc_id", "source", F.explode("tokens").alias("t")).select("doc_id", "source", "t.*")
    lines = payloads.ocr_lines(words).join(words.select("doc_id", "source").distinct(), "doc_id")
    by_line = Window.partitionBy("doc_id").orderBy("page", "block", "par", "line")
    more = F.create_map(F.lit("image_source"), F.lit("ocr"), F.lit("confidence"), F.col("confidence").cast("string"), F.lit("layout_source"), F.lit("image"))
    if languages:
        more = F.map_concat(more, F.create_map(F.lit("ocr_languages"), F.lit(languages)))
    candidates = lines.withColumns({"order_hint": F.row_number().over(by_line), "score": F.col("confidence"), "type": F.lit("paragraph"), "attrs": more})
    done = layout.merge(layout.process(candidates))
    seen = done.select("doc_id", "source", "type", "text", "attrs", "confidence", "page", (F.row_number().over(Window.partitionBy("doc_id").orderBy("batch", "order")) - 1).alias("place"), "bbox")
    none = F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>").alias("bbox")
    rows = found.where("tokens is null").select("doc_id", "source", "type", "text", "attrs", "confidence", "page", "place", none).unionByName(seen)
    read_any = F.max((F.element_at("attrs", "image_source") == "ocr").cast("int")).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("seen", F.coalesce(read_any, F.lit(0))).where((F.col("confidence") != NOTHING) | (F.col("text") != "Image contained no extractable text") | (F.col("seen") == 0)).drop("seen")
    place = Window.partitionBy("doc_id").orderBy("place", F.element_at("attrs", "key"))
    rows = rows.withColumn("pos", F.row_number().over(place) - 1).drop("place").where(F.col("pos") < limit)
    marker = F.col("pos") == limit - 1
    return rows.withColumns(
        {
            "type": F.when(marker, "metadata").otherwise(F.col("type")),
            "text": F.when(marker, f"Truncated after {limit - 1} structured blocks").otherwise(F.col("text")),
            "attrs": F.when(marker, F.create_map(F.lit("truncated"), F.lit("true"))).otherwise(F.col("attrs")),
            "confidence": F.when(marker, MARKER).otherwise(F.col("confidence")),
        }
    )
