"""Exact deduplication with a log-structured merge index of digests. DataFrame functions only.

flush    every task's rows are a memtable: its digests are written as one sorted run (Parquet), small columns only;
filters  every run has a filter: the slots, bit positions in buckets, that its digests hit. Filters of all runs are merged by
         slot, and the slots that two digests hit, of one run or of two, are one bitmap. A digest in another slot occurs
         once in the corpus: it is its own group, and never leaves its run;
compact  the rest of the runs is merged by digest into one sorted run with a row per digest: the identifier that stays, and
         how many rows have it. Map-side combining keeps a hot text from gathering in one task;
verify   texts whose digests occur more than once are compared byte by byte: they are grouped by (digest, text), combined on
         the map side. Digests shared by different texts are resolved by text.

The bitmap is sized by the number of rows and broadcast up to 64 MB (some 50 million rows). Beyond, the runs are compacted
whole, digests and numbers only, and texts to verify are found by their rows' numbers (see common.marked): the result is the
same, and no text is shuffled that isn't a hit.

Null texts count as empty. Of equal texts one row stays: the largest (or smallest) doc_id, ties by row number, so that
repeated rows keep exactly one. Null ids sort below all others; a group of null ids only keeps one with keep_id null. Texts
are read whole, however long. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_BUCKETS, filter_buckets, joined_hot, keep, marked, passes, slot, written


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def flush(docs: DataFrame, digest=sha256) -> DataFrame:
    """Sorted digest runs (digest, doc_id, row_no), one per task, in the shared folder."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(digest(text).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"))
    return written(rows.sortWithinPartitions("digest", "doc_id"))


def unmet(runs: DataFrame, rows: int) -> DataFrame:
    """runs with `met`: false where no other digest, of this run or another, hits the same slot of the runs' filters."""
    buckets = filter_buckets(rows)
    if buckets > MOST_BUCKETS:
        return runs.withColumn("met", F.lit(True))
    bucket, bit = slot(F.col("digest"), buckets)
    # what a task sums up before the shuffle is its run's filter
    slots = runs.select(bucket.alias("bucket"), bit.alias("bit")).groupBy("bucket", "bit").agg(F.count("*").alias("hits")).where("hits > 1")
    twice = slots.groupBy("bucket").agg(F.bitmap_construct_agg(F.col("bit")).alias("bits"))
    return passes(runs, F.col("digest"), twice, buckets, "met")


def compact(runs: DataFrame, keep_largest: bool = True) -> DataFrame:
    """One row per digest, in order of digests within each part: keeper (doc_id, row_no) and group_size."""
    best = F.max if keep_largest else F.min
    return runs.groupBy("digest").agg(best(F.struct("doc_id", "row_no")).alias("keeper"), F.count("*").alias("group_size")).sortWithinPartitions("digest")


def indexed(docs: DataFrame, keep_largest: bool = True, digest=sha256) -> tuple[DataFrame, DataFrame, int]:
    """The runs, with `met`; the merged run of the digests that occur more than once; and the number of rows."""
    runs = flush(docs, digest)
    rows = runs.count()
    runs = unmet(runs, rows)
    merged = written(compact(runs.where("met"), keep_largest).where("group_size > 1"))
    return runs, merged, rows


def verify(docs: DataFrame, merged: DataFrame, digest=sha256) -> DataFrame:
    """Digests that more than one text shares, found by comparing the bytes of every text whose digest is in the merged run."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(text.alias("text"), digest(text).alias("digest"))
    hits = marked(rows, F.col("digest"), merged.select(F.col("digest").alias("key")), "hit").where("hit")
    texts = hits.groupBy("digest", "text").agg(F.count("*").alias("n"))
    return texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")


def deduplicate(docs: DataFrame, keep_largest: bool = True, digest=sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest: one row per row of docs."""
    docs = docs.select("doc_id", "text")
    runs, merged, total = indexed(docs, keep_largest, digest)
    clashes = keep(verify(docs, merged, digest))
    rows = runs.select("digest", "doc_id", "row_no", "met", F.col("digest").alias("key"))
    by = merged.withColumnRenamed("digest", "key")
    if not clashes.isEmpty():  # texts that share a digest are told apart by themselves
        text = F.coalesce(F.col("text"), F.lit(""))
        again = docs.select(digest(text).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), text.alias("text"))
        apart = again.join(clashes, "digest", "left_semi").select("digest", "doc_id", "row_no", F.lit(True).alias("met"), F.concat_ws("|", "digest", "text").alias("key"))
        rows = written(apart.unionByName(rows.join(clashes, "digest", "left_anti")))
        best = F.max if keep_largest else F.min
        by = rows.where("met").groupBy("key").agg(best(F.struct("doc_id", "row_no")).alias("keeper"), F.count("*").alias("group_size"))
    alone = F.struct("doc_id", "row_no")
    out = joined_hot(rows.where("met"), by, "key", "group_size", total).unionByName(rows.where("not met"), allowMissingColumns=True)
    out = out.withColumns({"keeper": F.coalesce("keeper", alone), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    kept = F.col("row_no") == F.col("keeper.row_no")
    return out.select("doc_id", F.col("keeper.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "digest")


def distinct_documents(docs: DataFrame, keep_largest: bool = True, digest=sha256) -> DataFrame:
    """docs with one row of each group of equal texts (null counts as empty), all columns kept, of any type and name.

    Of rows that agree in id and text any one stays. Rows that the index's filter stops are alone and pass where they are.
    The others are grouped by their whole text, however long, and combined on the map side, so a hot text is one row per
    task before anything is shuffled. An empty table stays empty.
    """
    _, merged, _ = indexed(docs.select("doc_id", "text"), keep_largest, digest)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = marked(rows, digest(F.col("text")), merged.select(F.col("digest").alias("key")), "hit")
    sign = 1 if keep_largest else -1  # null ids are the least of all when the largest stays, and the last when the least does
    order = F.struct(F.col("doc_id").isNotNull(), F.col("doc_id") * sign)
    hits = rows.where("hit").groupBy("text").agg(F.max_by("row", order).alias("row"))
    return rows.where(~F.col("hit")).select("row.*").unionByName(hits.select("row.*"))


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, keep_id, group_size, kept, text_sha256; the largest doc_id of equal texts stays."""
    out = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumnRenamed("digest", "text_sha256")


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
