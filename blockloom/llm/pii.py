"""Personal data: base expressions, and bootstrapped contextual extraction on top. DataFrame functions only.

Base: e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers, leftmost and non-overlapping per kind.
Bootstrapping: base finds are seeds, whole. Other candidates are made of words that hold a digit or an @ and that no base
find touches: neighbours without letters and with one space between them are one candidate, of any number of words, and every
shorter sequence of them is one by its shape. Seeds and candidates induce the same lexical patterns: the word before, the two words before,
the word after (lower-cased, without punctuation around them), and the shape (digits as 9, runs of letters as a).
The graph of patterns and candidate values is scored in rounds until the sure patterns stay as they are: a pattern is
worth the share of its values that are believed to be of a kind (smoothed, so rare patterns are worth little), a value is
worth its best pattern. Patterns that are sure at the end add the candidates that stand in them, where their form allows
the kind (an @, or eight digits and no letter). Of finds that overlap the first stays, the longer of two that start alike.

Null and empty texts have no spans. Repeated rows are searched each, and count each. Extra columns are ignored; an empty
table gives an empty result. Text is read once, whole, however long; contexts are taken from all of it. Ties between kinds
go to the first kind. The graph holds words with digits only, as 128-bit digests, and is combined before it is shuffled;
joins on patterns are salted, as a shape can hold a third of all candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, lower_ascii, salted_join
from .spans import bare, counted, joined, touched, with_spans

KINDS = ["email", "ip", "card", "phone"]
# A match can only start where the one before ended or where the run of its first class starts: what is added to the
# contract's expressions spares the engine all other starts. Possessive repeats match the same and never backtrack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*"
# The lookbehinds let a match start at the first character of a word only, and possessive repeats never give back.
BEFORE = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]*+$"
TWO_BEFORE = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)[\x20\x09-\x0D]*+$"
AFTER = r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++)"
AROUND = r"^[^\p{L}\p{N}]++|(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$"
HEAD, TAIL = r"^[^\p{L}\p{N}+(]++", r"(?<![^\p{L}\p{N})])[^\p{L}\p{N})]++$"

LETTER = r"[\p{L}@]"

#: Words of a sequence all of whose parts are made. Of a longer one, parts of several words are made where a seed or a whole
#: candidate has their shape. That leaves out nothing: a shape is a function of the value and a part's only pattern, so
#: values of a shape that no seed and no whole candidate has are tied to each other only, and are never believed.
PARTS = 4

#: Smoothing of a pattern's share, and the share from which a pattern is sure.
SMOOTH, SURE = 2.0, 0.8


def luhn(digits: Column) -> Column:
    """True where a string of digits passes the Luhn check."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        doubled = d * 2
        return F.when(i % 2 == 0, d).when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _form(hit: Column) -> Column:
    """The kinds a candidate may be of by its form: 0 an address with @, 1 eight or more digits and no letter, else null."""
    return F.when(F.contains(hit, F.lit("@")), 0).when((F.length(_digits(hit)) >= 8) & ~hit.rlike(r"\p{L}"), 1)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _plain(word: Column) -> Column:
    """A context word: A-Z lower-cased, without punctuation around it unless it is all there is."""
    bare_word = F.regexp_replace(word, AROUND, "")
    return lower_ascii(F.when(bare_word == "", word).otherwise(bare_word))


def _shape(hit: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(hit, r"\p{L}+", "a"), "[0-9]", "9")


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, row_no, the four kinds' spans, and `word`: words with a digit or @, and what stands before and after them."""
    digit = F.col("t").rlike("[0-9]")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("t"), F.monotonically_increasing_id().alias("row_no"))
    at = F.contains("t", F.lit("@"))
    found = with_spans(rows, "t", {"email": (EMAIL, at), "ip": (IP, digit), "card": (CARD, digit), "phone": (PHONE, F.contains("t", F.lit("+"))), "word": (CANDIDATE, digit | at)})

    def card(s: Column) -> Column:
        d = _digits(s["hit"])
        return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)

    last = F.element_at("word", -1)["end"].cast("int")
    rest = F.when(F.size("word") > 0, F.substring("t", last + 1, F.length("t")))

    def context(s: Column, i: Column) -> Column:
        gap, following = s["gap"], F.coalesce(F.get("word", i + 1)["gap"], F.col("rest"))
        before, after = F.regexp_extract(gap, BEFORE, 1), F.regexp_extract(following, AFTER, 1)
        near = lambda word, other: F.when(word == "", F.coalesce(other["hit"], F.lit(""))).otherwise(word)
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["hit"].alias("hit"),
            ((i > 0) & (gap == " ") & ~s["hit"].rlike(LETTER) & ~F.get("word", i - 1)["hit"].rlike(LETTER)).alias("joined"),
            near(before, F.when(i > 0, F.get("word", i - 1))).alias("before"),
            F.regexp_extract(gap, TWO_BEFORE, 1).alias("two"),
            near(after, F.get("word", i + 1)).alias("after"),
        )

    return found.withColumn("rest", rest).select(
        "doc_id",
        "row_no",
        "email",
        F.filter("ip", lambda s: s["hit"].rlike(OCTETS)).alias("ip"),
        F.filter("card", card).alias("card"),
        F.filter("phone", lambda s: F.length(_digits(s["hit"])).between(9, 15)).alias("phone"),
        F.transform("word", context).alias("word"),
    )


def _patterns(before: str, two: str, after: str, shape: Column, whole: Column) -> Column:
    """Digests of a candidate's patterns; contexts count for whole candidates only."""
    said = lambda kind, text: F.when(text != "", _digest(F.concat(F.lit(kind), text)))
    two_words = F.when(F.col(two) != "", F.array_join(F.transform(F.split(two, r"[\x20\x09-\x0D]+"), _plain), " ")).otherwise("")
    context = [F.when(whole, said(k, t)) for k, t in (("L", _plain(F.col(before))), ("LL", two_words), ("R", _plain(F.col(after))))]
    return F.filter(F.array(*context, said("S", shape)), lambda p: p.isNotNull())


def seeds(rows: DataFrame) -> DataFrame:
    """pattern, value, kind of every base span, whole: its context is that of the words in which it starts and ends."""
    w = rows.select("row_no", F.explode("word").alias("w")).select("row_no", F.col("w.start").alias("pos"), F.lit(0).alias("is_base"), F.struct("w.before", "w.two").alias("head"), F.col("w.after").alias("after"), F.lit(None).cast("struct<start:long,end:long,hit:string,kind:int>").alias("s"))
    s = rows.select("row_no", F.explode("seed").alias("s"))
    none = w.schema["head"].dataType
    starts = s.select("row_no", F.col("s.start").alias("pos"), F.lit(1).alias("is_base"), F.lit(None).cast(none).alias("head"), F.lit(None).cast("string").alias("after"), "s")
    ends = s.select("row_no", (F.col("s.end") - 1).alias("pos"), F.lit(2).alias("is_base"), F.lit(None).cast(none).alias("head"), F.lit(None).cast("string").alias("after"), "s")
    before = Window.partitionBy("row_no").orderBy("pos", "is_base").rowsBetween(Window.unboundedPreceding, 0)
    seen = w.unionByName(starts).unionByName(ends)
    seen = seen.withColumn("head", F.last("head", ignorenulls=True).over(before)).withColumn("after", F.last("after", ignorenulls=True).over(before))
    # a seed's first row gives what stands before it, its last row what stands after it
    no = F.lit("")
    first = seen.where("is_base = 1").select("s", F.col("head.before").alias("before"), F.col("head.two").alias("two"), no.alias("after"), _shape(F.col("s.hit")).alias("shape"))
    final = seen.where("is_base = 2").select("s", no.alias("before"), no.alias("two"), "after", no.alias("shape"))
    found = first.unionByName(final)
    return found.select(F.explode(_patterns("before", "two", "after", F.col("shape"), F.lit(True))).alias("pattern"), _digest(F.col("s.hit")).alias("value"), F.col("s.kind").alias("kind"))


def candidates(rows: DataFrame) -> DataFrame:
    """row_no, start, end, form, value, patterns of sequences of free words."""
    order = Window.partitionBy("row_no").orderBy("start")
    free = touched(rows, "word", "base").select("row_no", "w.*", F.col("kind").isNull().alias("free"))
    free = free.withColumn("goes_on", F.col("joined") & F.col("free") & F.lag("free", 1, False).over(order))
    run = Window.partitionBy("row_no", "run")
    free = free.withColumn("run", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(order)).withColumn("words", F.count("*").over(run))
    ahead = F.array(*[F.struct(F.lead("goes_on", k, False).over(order).alias("goes_on"), F.lead("hit", k).over(order).alias("hit"), F.lead("end", k).over(order).alias("end"), F.lead("after", k).over(order).alias("after")) for k in range(1, PARTS + 1)])
    free = free.withColumn("ahead", ahead).where("free")

    def sequence(k: int) -> Column:
        more = [F.get("ahead", F.lit(j)) for j in range(k)]
        fits = F.lit(True) if k == 0 else F.col("words") <= PARTS
        for m in more:
            fits = fits & m["goes_on"]
        whole = ~F.col("goes_on") & (F.col("words") == k + 1)
        last = more[-1] if more else F.struct("end", "after")
        return F.when(fits, F.struct(F.concat_ws(" ", "hit", *[m["hit"] for m in more]).alias("hit"), last["end"].alias("end"), last["after"].alias("after"), whole.alias("whole")))

    sequences = F.filter(F.array(*[sequence(k) for k in range(PARTS)]), lambda s: s.isNotNull())
    out = free.select("row_no", "start", "before", "two", F.explode(sequences).alias("c")).select("row_no", "start", "before", "two", "c.*")
    # longer sequences: the words of one sequence of one text
    said = F.array_sort(F.collect_list(F.struct("start", "hit", "end", "before", "two", "after")))
    runs = keep(free.where(F.col("words") > PARTS).groupBy("row_no", "run").agg(said.alias("s")))
    long = runs.select("row_no", F.col("s")[0].alias("a"), F.element_at("s", -1).alias("z"), F.array_join(F.transform("s", lambda w: w["hit"]), " ").alias("hit"))
    out = keep(_trimmed(out.unionByName(long.select("row_no", "a.start", "a.before", "a.two", "hit", "z.end", "z.after", F.lit(True).alias("whole")))))
    told = out.where("whole").select("hit").unionByName(rows.select(F.explode("seed.hit").alias("hit"))).where(F.contains("hit", F.lit(" ")))
    no = F.lit("")
    parts = _trimmed(_parts(runs, told).select("row_no", "start", no.alias("before"), no.alias("two"), "hit", "end", no.alias("after"), F.lit(False).alias("whole")))
    patterns = _patterns("before", "two", "after", _shape(F.col("hit")), F.col("whole"))
    return out.unionByName(parts).select("row_no", "start", "end", _form(F.col("hit")).alias("form"), _digest(F.col("hit")).alias("value"), patterns.alias("patterns"))


def _trimmed(found: DataFrame) -> DataFrame:
    """Sequences without the punctuation around them; what is nothing else goes."""
    head, tail = F.length(F.regexp_extract("hit", HEAD, 0)), F.length(F.regexp_extract("hit", TAIL, 0))
    return found.withColumns({"start": F.col("start") + head, "end": F.col("end") - tail, "hit": F.regexp_replace(F.regexp_replace("hit", HEAD, ""), TAIL, "")}).where("hit <> ''")


def _parts(runs: DataFrame, told: DataFrame) -> DataFrame:
    """row_no, start, end, hit: the parts of several words of long sequences that have the shape of a hit in told.

    Parts are looked up by a hash of their words' shapes, for all lengths that told has; only those met are spelt out. One
    that is met by a clash of hashes does no harm (see PARTS).
    """
    shape = F.split(_shape(F.col("hit")), " ")
    shapes = keep(told.select(F.size(shape).alias("m"), F.xxhash64(shape).alias("key")).distinct())
    words = lambda f: F.transform("s", lambda w: _shape(f(w["hit"])))
    known = runs.select("row_no", "run", F.size("s").alias("n"), words(lambda h: h).alias("inner"), words(lambda h: F.regexp_replace(h, HEAD, "")).alias("first"), words(lambda h: F.regexp_replace(h, TAIL, "")).alias("last"))
    tried = known.join(F.broadcast(shapes.select("m").distinct()), F.col("m") < F.col("n"))
    m = F.col("m")

    def key(i: Column) -> Column:
        return F.xxhash64(F.concat(F.slice("first", i, F.lit(1)), F.slice("inner", i + 1, m - 2), F.slice("last", i + m - 1, F.lit(1))))

    tried = tried.select("row_no", "run", "m", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n") - m + 1), key)).alias("at", "key"))
    met = salted_join(tried, shapes.select("key").distinct(), "key", "row_no")
    met = met.groupBy("row_no", "run", "m").agg(F.collect_list("at").alias("at")).join(runs, ["row_no", "run"])

    def part(i: Column) -> Column:
        said = F.array_join(F.transform(F.slice("s", i + 1, m), lambda w: w["hit"]), " ")
        return F.struct(F.get("s", i)["start"].alias("start"), F.get("s", i + m - 1)["end"].alias("end"), said.alias("hit"))

    return met.select("row_no", F.explode(F.transform("at", part)).alias("p")).select("row_no", "p.*")


def bootstrap(words: DataFrame) -> DataFrame:
    """Sure patterns (pattern, kind, share) from (pattern, value, kind or null): the scored pattern-instance graph."""
    edges = keep(words.groupBy("pattern", "value", "kind").agg(F.count("*").alias("n")))
    degree = edges.groupBy("pattern").agg(F.sum("n").alias("all"))
    belief = edges.where("kind is not null").select("value", "kind", F.lit(1.0).alias("sure")).distinct()
    last, least = None, SURE / 2
    while True:
        # a belief never falls from round to round, so neither does a share, and the two sums tell whether one has grown
        believed = edges.drop("kind").join(belief, "value").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("sure")).alias("some"))
        patterns = keep(believed.join(degree, "pattern").select("pattern", "kind", (F.col("some") / (F.col("all") + SMOOTH)).alias("share")).where(F.col("share") >= least))
        sure = patterns.where(F.col("share") >= SURE)
        grown = sure.agg(F.count("*"), F.sum(F.floor(F.col("share") * 100))).first()
        if grown == last:
            return sure
        # only at first is a half-sure pattern believed: its own values would raise it to a sure one, whatever they are
        met = salted_join(edges.where("kind is null").select("pattern", "value"), patterns, "pattern", "value").select("value", "kind", F.col("share").alias("sure"))
        belief = keep(belief.unionByName(met).groupBy("value", "kind").agg(F.max("sure").alias("sure")))
        last, least = grown if least == SURE else None, SURE


def find(docs: DataFrame) -> DataFrame:
    """doc_id, row_no, base and more per row: arrays of (start, kind, end), kind an index of KINDS."""
    found = base_spans(docs)
    base = F.concat(*[bare(F.col(k), i) for i, k in enumerate(KINDS)])

    def seed(kind: str, rank: int) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), F.lit(rank).alias("kind")))

    rows = keep(found.select("doc_id", "row_no", base.alias("base"), F.concat(*[seed(k, i) for i, k in enumerate(KINDS)]).alias("seed"), "word"))
    others = keep(candidates(rows))
    edges = others.select(F.explode("patterns").alias("pattern"), "value", F.lit(None).cast("int").alias("kind"))
    sure = bootstrap(edges.unionByName(seeds(rows)))
    met = others.where("form is not null").select("row_no", "start", "end", "form", F.explode("patterns").alias("pattern"))
    met = salted_join(met, sure, "pattern", "row_no").where(F.col("form") == F.least("kind", F.lit(1)))
    new = met.groupBy("row_no", "start", "end").agg(F.max(F.struct("share", (-F.col("kind")).alias("kind"))).alias("best"))
    earlier = Window.partitionBy("row_no").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    new = new.withColumn("taken", F.max("end").over(earlier)).where("taken is null or start >= taken")
    more = new.groupBy("row_no").agg(F.collect_list(F.struct("start", (-F.col("best.kind")).alias("kind"), "end")).alias("more"))
    empty = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    return rows.join(more, "row_no", "left").select("doc_id", "row_no", "base", F.coalesce("more", empty).alias("more"))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans over all documents; and n_spans, n_added."""
    out = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [counted(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    every = F.concat("base", "more")
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"), joined(every, KINDS).alias("spans"), F.size(every).cast("long").alias("n_spans"), F.size("more").cast("long").alias("n_added"))
