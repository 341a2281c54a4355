"""Spans of regular expressions as array columns, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = "array<struct<start:long,end:long,hit:string,gap:string>>"
STEP = 256


def running(sizes: Column) -> Column:
    """Exclusive running sums of an array of longs. Summed in blocks, so that a long array costs far less than its square."""

    def scan(xs: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("t"), F.array().cast("array<long>").alias("a"))
        return F.aggregate(xs, zero, lambda s, x: F.struct((s["t"] + x).alias("t"), F.concat(s["a"], F.array(s["t"])).alias("a")))["a"]

    n = F.greatest(F.lit(1), F.ceil(F.size(sizes) / STEP).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.slice(sizes, b * STEP + 1, STEP))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + x))
    return F.flatten(F.zip_with(blocks, scan(sums), lambda b, o: F.transform(scan(b), lambda x: x + o)))


def with_spans(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add a column per pattern: the leftmost non-overlapping matches of its expression in `text`, in code points.

    patterns: name -> (expression, a cheap condition without which there is no match). Java's regexp gives matches and the
    gaps between them but no offsets; an offset is the running sum of the lengths before it. `gap` is the text between
    the previous match and this one. Matches must not be empty.
    """
    t = F.col(text)
    none = F.array().cast("array<string>")
    for name, (regex, needs) in patterns.items():
        df = df.withColumn(f"_m_{name}", F.when(needs, F.regexp_extract_all(t, F.lit(regex), F.lit(0))).otherwise(none))
    for name, (regex, _) in patterns.items():
        some = F.size(f"_m_{name}") > 0
        df = df.withColumn(f"_g_{name}", F.when(some, F.slice(F.split(t, regex, -1), F.lit(1), F.size(f"_m_{name}"))).otherwise(none))
    for name in patterns:
        sizes = F.zip_with(f"_g_{name}", f"_m_{name}", lambda g, m: (F.length(g) + F.length(m)).cast("long"))
        df = df.withColumn(f"_o_{name}", running(sizes))
    for name in patterns:
        made = F.zip_with(
            F.arrays_zip(F.col(f"_g_{name}").alias("g"), F.col(f"_m_{name}").alias("m")),
            f"_o_{name}",
            lambda x, o: F.struct((o + F.length(x["g"])).alias("start"), (o + F.length(x["g"]) + F.length(x["m"])).alias("end"), x["m"].alias("hit"), x["g"].alias("gap")),
        )
        df = df.withColumn(name, F.when(F.size(f"_m_{name}") > 0, made).otherwise(F.array().cast(SPAN)))
    return df.drop(*[f"_{k}_{name}" for k in "mgo" for name in patterns])


def bare(spans: Column, rank: int) -> Column:
    """Spans as (start, rank of the kind, end), which sorts as the contracts list them."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("kind"), s["end"].alias("end")))


def joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    shown = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(shown, ",")


def touched(rows: DataFrame, word: str, base: str) -> DataFrame:
    """row_no, w, kind: every element w of the array `word`, with the kind of a span of `base` that overlaps it, or null.

    A running maximum over a row's starts and ends, so that a text with many spans costs no product of the two arrays.
    """
    bound = "struct<end:long,kind:int>"
    w = rows.select("row_no", F.explode(word).alias("w")).select("row_no", F.col("w.end").alias("pos"), F.lit(0).alias("is_base"), "w", F.lit(None).cast(bound).alias("b"))
    kind = rows.schema[word].dataType.elementType
    b = rows.select("row_no", F.explode(base).alias("s")).select("row_no", F.col("s.start").alias("pos"), F.lit(1).alias("is_base"), F.lit(None).cast(kind).alias("w"), F.struct("s.end", "s.kind").cast(bound).alias("b"))
    before = Window.partitionBy("row_no").orderBy("pos", "is_base").rowsBetween(Window.unboundedPreceding, 0)
    seen = w.unionByName(b).withColumn("last", F.max("b").over(before)).where("is_base = 0")
    return seen.select("row_no", "w", F.when(F.col("last.end") > F.col("w.start"), F.col("last.kind")).alias("kind"))


def counted(spans: Column, rank: int) -> Column:
    """How many of the spans are of one kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == rank)).cast("long")
