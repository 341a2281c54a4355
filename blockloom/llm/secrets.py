"""Secrets: base expressions, and a randomness test battery on top. DataFrame functions only.

Base: assignments, access keys and long hexadecimal runs, leftmost and non-overlapping per kind.
Battery: every other token of 20 or more key characters is tested as its narrowest encoding (hexadecimal, base 36, base
62, base 64): chi-squared uniformity (over the symbols where five of each are expected, else over eight parts of the
alphabet, with the counts that their sizes let expect), a runs test around the alphabet's middle, and lag-1 serial
correlation. The last two depend on each other, so the three are joined by the Cauchy combination, which holds under any
dependence, into one p-value of randomness.
False discoveries are held down by length: the p-values of a band of lengths, over the whole corpus, are a mixture of
uniform ones (random tokens) and ones that crowd at 0 (other tokens; from 0.001 on a falling power of p). The mixture is
fitted per band by maximum likelihood over bin counts, and the smallest cut is taken above which the fitted share of other
tokens stays within 5 %; no cut, no report. Neighbouring bands of under THIN tokens are fitted together. No band is gathered anywhere: counts are.

Null and empty texts have no spans. Repeated rows are searched each, and their tokens count each. Ties at a cut are all
reported. Extra columns are ignored; an empty table gives an empty result. Text is read once, whole, however long.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep
from .spans import bare, counted, joined, touched, with_spans

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
VALUE = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs are taken whole, so a run that is too short holds no longer one: the least length can stand in the expression.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"

DIGITS, LOW, UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Narrowest first: name, what a token must look like, alphabet in order.
ENCODINGS = [("hex", "^[0-9a-f]+$|^[0-9A-F]+$", DIGITS + "abcdef"), ("base36", "^[0-9a-z]+$|^[0-9A-Z]+$", DIGITS + LOW), ("base62", "^[0-9A-Za-z]+$", DIGITS + UP + LOW), ("base64", "", UP + LOW + DIGITS + "+/")]
WITHIN, PARTS, EXPECTED, THIN = 0.05, 8, 5, 50
#: Bins of p (the lowest p is left out of the fit), cuts that may be taken, and the mixtures that are fitted: exponents of
#: the density that falls off from 0, and steps of the uniform one's share.
EDGES = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 1.0)
CUTS = (0.01, 0.02, 0.03, 0.05, 0.1, 0.2, 0.35, 0.5)
POWERS, SHARES = (-2.0, -1.0, -0.5, -0.2, 0.1), 100


def upper_tail(z: Column) -> Column:
    """Upper tail of the normal distribution (a rational approximation, within 1e-7)."""
    x = F.least(F.abs(z), F.lit(30.0))
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _places(token: Column, alphabet: str) -> Column:
    """Each character's place in the alphabet."""
    return F.transform(F.split(token, ""), lambda c: (F.instr(F.lit(alphabet), c) - 1).cast("double"))


def battery(tokens: DataFrame) -> DataFrame:
    """Add encoding, n (characters) and p (0: surely no random string) to tokens (token)."""
    body = F.translate(F.regexp_replace("token", "=+$", ""), "-_=", "+/")
    tokens = tokens.withColumn("_b", body)
    name, index, size = F.lit("base64"), None, F.lit(64)
    for enc, form, alphabet in reversed(ENCODINGS):
        cased = F.lower("_b") if enc in ("hex", "base36") else F.col("_b")
        at = _places(cased, alphabet)
        fits = F.col("_b").rlike(form) if form else F.lit(True)
        name, size = (F.lit(enc), F.lit(len(alphabet))) if index is None else (F.when(fits, enc).otherwise(name), F.when(fits, len(alphabet)).otherwise(size))
        index = at if index is None else F.when(fits, at).otherwise(index)
    tokens = tokens.withColumn("encoding", name).withColumn("_x", index).withColumn("_k", size).withColumn("n", F.size("_x").cast("long"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    tokens = tokens.withColumn("_mean", total(F.col("_x")) / F.col("n")).withColumn("_hi", F.transform("_x", lambda x: (x * 2 >= F.col("_k")).cast("int")))
    # symbols per part: part g holds the places k with floor(k * parts / alphabet) = g
    parts = F.when(F.col("n") >= EXPECTED * F.col("_k"), F.col("_k")).otherwise(PARTS)
    tokens = tokens.withColumn("_parts", parts)
    first_of = lambda g: F.ceil(g * F.col("_k") / F.col("_parts"))
    seen = F.transform("_x", lambda x: F.floor(x * F.col("_parts") / F.col("_k")))

    def part(g: Column) -> Column:
        expected = F.col("n") * (first_of(g + 1) - first_of(g)) / F.col("_k")
        found = F.size(F.filter("_seen", lambda x: x == g))
        return (found - expected) * (found - expected) / expected

    tokens = tokens.withColumn("_seen", seen)
    chi = total(F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), part))
    free = F.col("_parts") - 1
    z_chi = (F.cbrt(chi / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    later = lambda a: F.slice(a, F.lit(2), F.size(a))
    first = lambda a: F.slice(a, F.lit(1), F.size(a) - 1)
    ones = F.aggregate("_hi", F.lit(0), lambda s, x: s + x).cast("double")
    zeros = F.col("n") - ones
    runs = 1 + F.aggregate(F.zip_with(first(F.col("_hi")), later(F.col("_hi")), lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, x: s + x)
    mean_runs = 1 + 2 * ones * zeros / F.col("n")
    var_runs = F.when((ones > 0) & (zeros > 0), (mean_runs - 1) * (mean_runs - 2) / (F.col("n") - 1))
    z_runs = F.when(var_runs > 0, (runs - mean_runs) / F.sqrt(var_runs)).otherwise(30.0)
    dev = F.transform("_x", lambda x: x - F.col("_mean"))
    var = total(F.transform(dev, lambda d: d * d))
    cov = total(F.zip_with(first(dev), later(dev), lambda a, b: a * b))
    z_corr = F.when(var > 0, (cov / var + 1 / F.col("n")) * F.col("n") * F.sqrt(F.col("n") - 1) / (F.col("n") - 2)).otherwise(30.0)
    tests = [upper_tail(z_chi), 2 * upper_tail(F.abs(z_runs)), 2 * upper_tail(F.abs(z_corr))]
    tokens = tokens.withColumns({f"_p{k}": F.least(F.greatest(p, F.lit(1e-15)), F.lit(0.99)) for k, p in enumerate(tests)})
    mean = sum(F.tan((0.5 - F.col(f"_p{k}")) * math.pi) for k in range(len(tests))) / len(tests)
    # 1/2 - atan(mean)/pi, written so that small values keep their digits
    p = F.when(mean > 1, F.atan(1 / mean) / math.pi).otherwise(0.5 - F.atan(mean) / math.pi)
    return tokens.withColumn("p", p).drop("_b", "_x", "_k", "_mean", "_hi", "_parts", "_seen", *[f"_p{k}" for k in range(len(tests))])


def _bin(p: Column) -> Column:
    """Number of the bin of EDGES that p lies in; 0 below."""
    return sum((p >= e).cast("int") for e in EDGES[:-1])


def _band(n: Column) -> Column:
    """Bands of lengths that double: 20-31, 32-63, 64-127, ..."""
    return F.floor(F.log2(n)).cast("int")


def cuts(tokens: DataFrame) -> DataFrame:
    """(band, least): the least p that may be reported in each band of lengths. Works on a row per band and bin."""
    count = tokens.groupBy(_band(F.col("n")).alias("band"), _bin(F.col("p")).alias("bin")).agg(F.count("*").alias("c"))
    # bands by length, with those before them: a group ends where THIN tokens are reached; at most 31 rows
    sizes = count.groupBy("band").agg(F.sum("c").alias("size"))
    before = F.sum("size").over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1))
    group = F.floor(F.least(F.coalesce(before, F.lit(0)), F.lit(1 << 50)) / THIN)
    total = F.sum("size").over(Window.partitionBy())
    # what is left at the end and too thin joins the group before it
    named = sizes.withColumn("group", F.least(group, F.greatest(F.lit(0), F.floor((total - THIN) / THIN)))).select("band", "group")
    pooled = count.join(F.broadcast(named), "band").groupBy("group", "bin").agg(F.sum("c").alias("c"))
    low, high = (F.element_at(F.array(*map(F.lit, EDGES)), F.col("bin") + k) for k in (0, 1))
    powers = F.explode(F.array(*map(F.lit, POWERS))).alias("power")
    shares = F.explode(F.transform(F.sequence(F.lit(0), F.lit(SHARES)), lambda k: k / SHARES)).alias("share")
    fits = pooled.where("bin > 0").select("group", "c", low.alias("low"), high.alias("high"), powers).select("group", "c", "low", "high", "power", shares)

    def uniform(low: Column, high: Column) -> Column:
        return (high - low) / (1 - EDGES[0])

    def falling(power: Column, low: Column, high: Column) -> Column:
        return (F.pow(high, power) - F.pow(low, power)) / (1 - F.pow(F.lit(EDGES[0]), power))

    chance = F.col("share") * uniform(F.col("low"), F.col("high")) + (1 - F.col("share")) * falling(F.col("power"), F.col("low"), F.col("high"))
    fits = fits.groupBy("group", "power", "share").agg(F.sum(F.col("c") * F.log(F.greatest(chance, F.lit(1e-300)))).alias("likely"))
    best = fits.groupBy("group").agg(F.max(F.struct("likely", (-F.col("share")).alias("other"), "power")).alias("fit"))

    def fine(cut: float) -> Column:
        random = -F.col("fit.other") * uniform(F.lit(cut), F.lit(1.0))
        wrong = (1 + F.col("fit.other")) * falling(F.col("fit.power"), F.lit(cut), F.lit(1.0))
        return F.when((random > 0) & (wrong <= WITHIN * (random + wrong)), F.lit(cut))

    fine = F.coalesce(*map(fine, CUTS))
    return named.join(best.select("group", fine.alias("least")).where("least is not null"), "group").select("band", "least")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, row_no, base and more per row: arrays of (start, kind, end), kind an index of KINDS."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("t"), F.monotonically_increasing_id().alias("row_no"))
    found = with_spans(rows, "t", {"assign": (ASSIGN, F.col("t").rlike("[:=]")), "access": (ACCESS, F.contains("t", F.lit("AKIA"))), "hex": (HEX, F.lit(True)), "token": (TOKEN, F.lit(True))})
    found = found.withColumn("assign", F.filter("assign", lambda s: F.length(F.regexp_extract(s["hit"], VALUE, 1)) >= 6))
    base = F.concat(*[bare(F.col(k), i) for i, k in enumerate(KINDS[:3])])
    rows = found.select("doc_id", "row_no", base.alias("base"), "token")
    brief = F.transform("token", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("token")))
    rows = keep(rows.withColumn("token", brief))
    other = touched(rows, "token", "base").where("kind is null").select("row_no", "w.start", "w.end", "w.token")
    tokens = keep(battery(other).drop("token"))
    least = F.broadcast(cuts(tokens))  # one row per band: at most 31
    new = tokens.withColumn("band", _band(F.col("n"))).join(least, "band").where("p >= least")
    more = new.groupBy("row_no").agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("more"))
    empty = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    return rows.join(more, "row_no", "left").select("doc_id", "row_no", "base", F.coalesce("more", empty).alias("more"))


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, n_assign, n_access, n_hex, base_sha256, spans over all documents; and n_spans, n_added."""
    out = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [counted(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    every = F.concat("base", "more")
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"), joined(every, KINDS).alias("spans"), F.size(every).cast("long").alias("n_spans"), F.size("more").cast("long").alias("n_added"))
