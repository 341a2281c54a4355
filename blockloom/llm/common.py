"""Helpers shared by the corpus operators: where tables are kept between jobs, ASCII folding, graph components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word characters of the contracts: everything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Byte map that lower-cases A-Z only. UTF-8 keeps those bytes for ASCII, so it is safe on encoded text.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In a session of one process one of our own will do."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="blockloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _own_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame) -> DataFrame:
    """Write a wide table as Parquet in the shared folder and read it back (columnar and compressed, unlike a checkpoint)."""
    spark = df.sparkSession
    path = _own_path(spark, uuid.uuid4().hex)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Write a table in the shared folder in buckets by key and read it back: grouping by the key shuffles it no more.

    Buckets are known to a catalog table only; its entry is dropped as soon as the table is read, the files stay.
    """
    spark = df.sparkSession
    name = f"blockloom_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", _own_path(spark, name)).bucketBy(partitions(spark), key).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def trim() -> None:
    """Give freed memory back to the system, as a worker lives on after a batch."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bits of one bucket of a filter (4 KB), bits for each key, and the largest filter that is broadcast: 64 MB.
BUCKET_BITS, BITS_PER_KEY, MOST_BUCKETS = 32768, 10, 16384


def filter_buckets(keys: int) -> int:
    """Buckets of a filter for so many keys: a power of two. Over MOST_BUCKETS (some 50 million keys) it must not be broadcast."""
    return max(16, 1 << (max(1, keys * BITS_PER_KEY // BUCKET_BITS) - 1).bit_length())


def slot(key: Column, buckets: int) -> tuple[Column, Column]:
    """Bucket and bit of a key in a filter."""
    h = F.xxhash64(key)
    return F.pmod(h, F.lit(buckets)), F.pmod(F.shiftright(h, 32), F.lit(BUCKET_BITS))


def passes(rows: DataFrame, key: Column, table: DataFrame, buckets: int, name: str) -> DataFrame:
    """Add `name`: whether the filter table (bucket, bits) lets the row's key pass. It is broadcast: callers check its size.

    rows must not have columns of the names used here: callers carry what they don't know as one struct.
    """
    bucket, bit = slot(key, buckets)
    rows = rows.withColumns({"in_bucket": bucket, "in_bit": bit})
    table = table.select(F.col("bucket").alias("of_bucket"), F.col("bits").alias("of_bits"))
    rows = rows.join(F.broadcast(table), F.col("in_bucket") == F.col("of_bucket"), "left")
    byte = F.conv(F.hex(F.substring("of_bits", F.floor(F.col("in_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.pow(F.lit(2), F.col("in_bit") % 8).cast("int")) != 0
    return rows.withColumn(name, F.coalesce(hit, F.lit(False))).drop("in_bucket", "in_bit", "of_bucket", "of_bits")


def marked(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """Add `name`: false for rows whose key is not in keys (key). True may be wrong for a few others.

    With a filter of keys, sized by their number, where that is small enough to broadcast. Beyond, rows are laid down in
    buckets by number; their keys' hashes and numbers alone are shuffled to the keys; and the numbers that are hit come back
    to the buckets. Whole rows are never shuffled, whatever the number of keys.
    """
    buckets = filter_buckets(keys.count())
    if buckets > MOST_BUCKETS:
        stored = bucketed(rows.withColumn("row_at", F.monotonically_increasing_id()), "row_at")
        known = keys.select(F.xxhash64("key").alias("of_key")).distinct()
        asked = stored.select("row_at", F.xxhash64(key).alias("of_key"))
        hits = bucketed(asked.join(known.hint("merge"), "of_key").select("row_at", F.lit(True).alias("of_hit")), "row_at")
        met = stored.join(hits.hint("shuffle_hash"), "row_at", "left")
        return met.withColumn(name, F.col("of_hit").isNotNull()).drop("row_at", "of_hit")
    bucket, bit = slot(F.col("key"), buckets)
    table = keys.select(bucket.alias("bucket"), bit.alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg(F.col("bit")).alias("bits"))
    return passes(rows, key, table, buckets, name)


#: A key with over one in HOT of all rows is hot: there are fewer than HOT of them at any size.
HOT = 1000


def joined_hot(rows: DataFrame, found: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows left-joined with found (a row for each key, with `size`, the number of its rows): hot keys are broadcast.

    All others have a thousandth of the rows at most, so no task of the shuffled join gets much more than others.
    """
    hot = F.col(size) * HOT > total
    few = F.broadcast(found.where(hot))
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(found.where(~hot).hint("merge"), key, "left"), allowMissingColumns=True)


#: Parts that the rows of one key of a salted join are dealt over.
SALTS = 16


def salted_join(rows: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """rows joined with few (a row or some for each key) on `key`; a key's rows are dealt by `by` over SALTS parts."""
    dealt = few.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(dealt, [key, "salt"]).drop("salt")


def without(docs: DataFrame, gone: DataFrame, single: DataFrame) -> DataFrame:
    """docs without the rows whose (doc_id, xxhash64(text)) is in gone, and with one row of each that is in single.

    Only rows that a fixed filter lets pass are shuffled; all others stay where they are.
    """
    known = gone.select("doc_id", "text_key", F.lit(True).alias("drop")).unionByName(single.select("doc_id", "text_key", F.lit(False).alias("drop")))
    known = keep(known)
    key = F.struct("doc_id", "text_key")
    keys = known.select(key.alias("key"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    rows = marked(rows, key, keys, "hit")
    known = known.select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_text"), "drop")
    met = rows.where("hit").join(known, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_text")), "left")
    stay = met.where("drop is null").select("row")
    one = met.where("not drop").groupBy("doc_id", "text_key").agg(F.any_value("row").alias("row")).select("row")
    return rows.where(~F.col("hit")).select("row").unionByName(stay).unionByName(one).select("row.*")


def held_out(doc_id: str, folds: int) -> Column:
    """True where crc32(doc_id as text) mod folds is 0; a null id counts as the empty text, so it is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) per node that has an edge; root is its least node.

    Each round every node hooks to its least neighbour, pointers are halved, and the edges are contracted to roots,
    so the edge table shrinks geometrically. Only joins and partial aggregates: a hub's edges are never gathered in
    one task (AQE splits skewed joins), and nothing but a count reaches the driver.
    """
    live = keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
        hook = keep(hook)
        jump = hook.select(F.col("node").alias("mid"), F.col("up").alias("top"))
        hook = keep(hook.join(jump, hook.up == jump.mid, "left").select("node", F.coalesce("top", "up").alias("up")))
        if labels is None:
            labels = hook.select("node", F.col("up").alias("root"))
        else:
            step = hook.select(F.col("node").alias("at"), "up")
            labels = keep(labels.join(step, labels.root == step["at"], "left").select("node", F.coalesce("up", "root").alias("root")))
        ha, hb = (hook.select(F.col("node").alias(f"node_{x}"), F.col("up").alias(f"up_{x}")) for x in "ab")
        live = live.join(ha, F.col("a") == F.col("node_a")).join(hb, F.col("b") == F.col("node_b")).where("up_a <> up_b")
        live = keep(live.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct())
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
