"""Language identification by character n-grams learnt from a table: profiles as a small table, scores as a join and sums.

A text (whole, or its first `chars` characters; lower-cased, letters only, words apart by one space) is cut into overlapping
n-grams. For each language the `size` most frequent n-grams of its learning texts (ties by the n-gram) make its profile; their
weights are log10 of (count + 0.5) / (all n-grams of the language + 0.5 * all n-grams in profiles), others weigh as count 0.
A text's score for a language is the sum of the weights of its n-grams, its guesses are the posterior shares under equal
priors. The table of profiles has `size` rows per language at most; it is broadcast while it is under MOST_ROWS, else joined.

Null, empty and letterless texts get no guess, nor does any text when nothing was learnt. Texts without a language are not
learnt from. Repeated rows count as often as they occur when learning, and get a guess each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.language import GUESSES, LEAST_SHARE, MOST_GUESSES
from ..schema import once
from ..workspace import written

#: Characters of an n-gram, n-grams of a profile, languages at most, and the largest table that is broadcast.
N, SIZE, MOST_LANGS, MOST_ROWS = 3, 3000, 500, 1_000_000


def grams(text: Column, n: int = N, chars: int | None = None) -> Column:
    """Overlapping n-grams of a text, or of its first `chars` characters."""
    whole = F.coalesce(text, F.lit(""))
    letters = F.trim(F.regexp_replace(F.lower(F.substring(whole, 1, chars) if chars else whole), r"[^\pL]+", " "))
    padded = F.concat(F.lit(" "), letters, F.lit(" "))
    # a look-ahead matches at every place, in one pass over the text
    found = F.regexp_extract_all(padded, F.lit(f"(?=(.{{{n}}}))"), F.lit(1))
    return F.when(letters != "", found).otherwise(F.array().cast("array<string>"))


@dataclass
class Profiles:
    """langs in order; table: (gram, w), w a weight per language; floor: what any other n-gram weighs in each."""

    langs: list[str]
    table: DataFrame
    floor: list[float]
    n: int
    chars: int | None


def learn(docs: DataFrame, lang: str = "lang", n: int = N, size: int = SIZE, chars: int | None = None) -> Profiles:
    """Profiles of the languages in docs (text, lang)."""
    seen = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(grams(F.col("text"), n, chars)).alias("gram"))
    counts = written(seen.groupBy("lang", "gram").agg(F.count("*").alias("c")))
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("c").alias("n")).orderBy("lang").limit(MOST_LANGS + 1).collect()}
    if len(totals) > MOST_LANGS:
        raise ValueError(f"over {MOST_LANGS} languages")
    langs = sorted(totals)
    top = Window.partitionBy("lang").orderBy(F.desc("c"), "gram")
    profile = counts.withColumn("r", F.row_number().over(top)).where(F.col("r") <= size)
    kept = written(profile.groupBy("gram").agg(*[F.max(F.when(F.col("lang") == x, F.col("c"))).alias(f"c{k}") for k, x in enumerate(langs)], F.count("*").alias("in_profiles")))
    v = kept.count()
    below = [totals[x] + 0.5 * v for x in langs]
    weights = [F.log10((F.coalesce(f"c{k}", F.lit(0)) + 0.5) / b) for k, b in enumerate(below)] or [F.lit(None).cast("double")]
    weights = F.array(*weights)
    return Profiles(langs, written(kept.select("gram", weights.alias("w"))), [math.log10(0.5 / b) for b in below], n, chars)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """docs (any columns, text) with `guesses`: languages with their shares, most likely first, as functions.language gives them."""
    if not profiles.langs:
        return docs.withColumn("guesses", F.array().cast(GUESSES))
    rows = written(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("row_no")))
    each = rows.select("row_no", F.explode(grams(F.col("row.text"), profiles.n, profiles.chars)).alias("gram"))
    table = F.broadcast(profiles.table) if profiles.table.count() <= MOST_ROWS else profiles.table
    met = each.join(table, "gram", "left")
    sums = [F.sum(F.coalesce(F.get("w", F.lit(k)), F.lit(f))).alias(f"s{k}") for k, f in enumerate(profiles.floor)]
    scores = met.groupBy("row_no").agg(*sums)
    best = F.greatest(*[F.col(f"s{k}") for k in range(len(sums))]) if len(sums) > 1 else F.col("s0")
    shares = [F.pow(F.lit(10.0), F.col(f"s{k}") - best) for k in range(len(sums))]
    whole = sum(shares[1:], shares[0])
    ordered = F.array_sort(F.array(*[F.struct((-s / whole).alias("loss"), F.lit(x).alias("lang")) for s, x in zip(shares, profiles.langs)]))
    kept = F.slice(F.filter(ordered, lambda g: -g["loss"] >= LEAST_SHARE), 1, MOST_GUESSES)
    found = once(scores, guesses=F.transform(kept, lambda g: F.struct(g["lang"].alias("lang"), (-g["loss"]).alias("prob")))).select(F.col("row_no").alias("of"), "guesses")
    out = rows.join(found, F.col("row_no") == F.col("of"), "left")
    return out.select("row.*", F.coalesce("guesses", F.array().cast(GUESSES)).alias("guesses"))
