"""Text segmentation and block classification as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: limits and patterns that decide types and attributes
MAX_CHARS = 600
MAX_LINES, MAX_LINE = 16, 200
LIST_MARK = r"(?U)^(?:[-*•・]|\d+[.)])\s+"
DATE_PREFIX = r"(?U)^\[?\d{4}[-/]\d{2}[-/]\d{2}"
SENTENCE_END = r"(?U)(?<=[.!?。！？])\s+(?=[\w\"'(])"
KEY_VALUE = r"(?Ud)^([\w .#/@&()'\-]{1,64})\s*(?:=>|->|[:=]|：)\s*(.+)$"
LOG_LINE = r"(?Ud)^\[?(\d{4}[-/]\d{2}[-/]\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:?\d{2})?)?)\]?\s*(.*)$"
MAIL_KEYS = ("title:", "subject:", "from:", "to:", "cc:")
CONFIDENCE = {"kv": 0.75, "log": 0.6, "list_item": 0.7, "heading": 0.8, "metadata": 0.6, "other": 0.3}
DEFAULT_CONFIDENCE = 0.5

#: Everything that ends a line in Unicode text.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def newlines(c: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(c, "\r\n?", "\n")


def lines(c: Column) -> Column:
    """Lines of a text; a line end at the very end starts no further line."""
    return F.split(F.regexp_replace(c, f"(?:{LINE_END})\\z", ""), LINE_END)


def full_lines(c: Column) -> Column:
    return F.filter(lines(c), lambda x: strip(x) != "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, rf"(?U){SPACE}+"), lambda x: x != "")


def paragraphs(c: Column) -> Column:
    """Runs of lines that are not blank."""
    flat = F.regexp_replace(c, LINE_END, "\n")
    blank = r"[^\S\n]*"
    parts = F.split(flat, rf"(?U)\n(?:{blank}\n)+")
    trimmed = F.transform(parts, lambda p: F.regexp_replace(p, rf"(?U)\A(?:{blank}\n)+|(?:\n{blank})+\z", ""))
    return F.filter(trimmed, lambda p: strip(p) != "")


def short_lines(c: Column) -> Column:
    """A structured chunk (few lines, all short) as its lines; any other as one piece."""
    full = full_lines(c)
    few = (F.size(full).between(1, MAX_LINES)) & F.forall(full, lambda x: F.length(x) < MAX_LINE)
    return F.when(F.contains(c, F.lit("\n")) & few, full).otherwise(F.array(c))


def slices(c: Column, size: int) -> Column:
    """Pieces of `size` characters."""
    n = F.ceil(F.length(c) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.substring(c, k * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_END), strip), lambda s: s != "")


def packed(parts: Column, size: int = MAX_CHARS) -> Column:
    """Join neighbours with a space as long as they fit into `size` characters."""
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, part: Column) -> Column:
        joined = F.concat(s["now"], F.lit(" "), part)
        fits = F.length(joined) <= size
        first = s["now"] == ""
        return F.struct(
            F.when(first, part).when(fits, joined).otherwise(part).alias("now"),
            F.when(first | fits, s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))).alias("done"),
        )

    return F.aggregate(parts, start, step, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))


def shatter(c: Column) -> Column:
    """Chunks of at most MAX_CHARS: packed sentences, or slices where there is but one sentence."""
    text = strip(c)
    found = sentences(text)
    return F.when(F.length(text) <= MAX_CHARS, F.array(text)).when(F.size(found) > 1, packed(found)).otherwise(slices(text, MAX_CHARS))


def chunks(c: Column) -> Column:
    """Paragraphs, then lines or sentences; trimmed, none empty. (Tables are told apart in operators.text_blocks.)"""
    pieces = F.flatten(F.transform(paragraphs(c), short_lines))
    return F.filter(F.transform(F.flatten(F.transform(pieces, shatter)), strip), lambda x: x != "")


def classify(c: Column) -> Column:
    """Type of a chunk; the first rule that fits decides."""
    text = strip(c)
    rows = lines(text)
    mail = F.lower(text)
    is_mail = mail.startswith(MAIL_KEYS[0])
    for key in MAIL_KEYS[1:]:
        is_mail = is_mail | mail.startswith(key)
    return (
        F.when(text == "", "other")
        .when(text.startswith("#") & (F.regexp_count(text, F.lit("#")) <= 6), "heading")
        .when((F.upper(text) == text) & (F.size(words(text)) <= 6), "heading")
        .when(text.rlike(LOG_LINE), "log")
        .when(text.rlike(KEY_VALUE), "kv")
        .when((F.size(rows) == 1) & (F.length(text) <= 80) & is_mail, "kv")
        .when(F.forall(rows, lambda x: x.rlike(LIST_MARK)), "list_item")
        .when(text.rlike(DATE_PREFIX), "metadata")
        .when((F.size(rows) <= 6) & F.forall(rows, lambda x: F.contains(x, F.lit(":"))), "metadata")
        .otherwise("paragraph")
    )


def confidence(kind: Column) -> Column:
    out = F.lit(DEFAULT_CONFIDENCE)
    for name, value in CONFIDENCE.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def attributes(kind: Column, c: Column) -> Column:
    """key and value of kv chunks, timestamp and message of log chunks; else an empty map."""
    text = strip(c)
    part = lambda pattern, k: strip(F.regexp_extract(text, pattern, k))
    none = F.create_map().cast("map<string,string>")
    return (
        F.when((kind == "kv") & text.rlike(KEY_VALUE), F.create_map(F.lit("key"), part(KEY_VALUE, 1), F.lit("value"), part(KEY_VALUE, 2)))
        .when(kind == "log", F.create_map(F.lit("timestamp"), F.regexp_extract(text, LOG_LINE, 1), F.lit("message"), part(LOG_LINE, 2)))
        .otherwise(none)
    )


def messages(source: Column, mime: Column, text: Column, size: int = 2000) -> Column:
    """A payload as message texts of `size` characters, numbered where there are several; an empty text gives a placeholder."""
    head = F.concat(F.lit("["), mime, F.lit("] "), source)
    part = lambda p, i: F.concat(head, F.when(F.length(text) > size, F.concat(F.lit(" (part "), (i + 1).cast("string"), F.lit(")"))).otherwise(""), F.lit("\n"), p)
    return F.when(F.length(text) > 0, F.transform(slices(text, size), part)).otherwise(F.array(F.concat(head, F.lit("\n(no textual preview available)"))))
