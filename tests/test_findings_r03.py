"""Inputs on which queries once differed from their SQL, or that they once left out."""

import duckdb
import pytest

import __spark_entry__ as entry
from test_queries import shown


def against_sql(spark, tmp_path, name, **tables):
    """Rows of a query and of its SQL over made tables: {table: (rows, schema)}."""
    c = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        c.sql(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet/*.parquet'")
    return shown(entry.queries()[name](spark, str(tmp_path)).toPandas()), shown(c.sql(entry.oracle_sql()[name]).df())


# lengths at which the score of an assistant's turn and that of a user's turn are equal but for the last bit of exp
TIES = [(4909, 0, "user", "a" * 274), (4909, 1, "assistant", "b" * 925), (4909, 3, "assistant", "c" * 881), (4909, 4, "user", "d" * 131), (4909, 2, "user", "e" * 120)]
TIES += [(k, t, r, x * n) for k in range(750) for t, r, x, n in ((0, "assistant", "x", 750 + k), (1, "user", "y", k), (2, "assistant", "z", 751 + k), (3, "user", "w", k + 1), (4, "user", "v", k + 1))]
TURNS = (TIES, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("name", ["escalate_enrich", "escalate_prompt", "escalate_topk", "selection_events"])
def test_scores_order_like_sql(spark, tmp_path, name):
    got, want = against_sql(spark, tmp_path, name, conversations=TURNS)
    assert got == want


def test_scores_of_all_lengths_equal_sql(spark):
    """To the last bit, so that no tie can be ordered in another way, whatever the texts."""
    from pyspark.sql import functions as F

    from blockloom.functions.features import score
    from blockloom.plans.queries import _SCORE

    blocks = spark.range(5000).select(F.col("id").alias("n"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"), F.explode(F.array(F.lit(0.4), F.lit(0.55))).alias("confidence"))
    got = {(r.n, r.confidence): r.s for r in blocks.select("n", "confidence", score(blocks).alias("s")).collect()}
    sql = _SCORE.format(c="c", t="repeat('x', CAST(n AS INTEGER))")
    assert got == {(n, float(c)): s for n, c, s in duckdb.connect().sql(f"SELECT n, c, {sql} FROM (SELECT n, unnest([0.4::DOUBLE, 0.55::DOUBLE]) AS c FROM range(5000) t(n))").fetchall()}


# turns without text, without a place, alone and beside others; conversations without any text
ODD = [(k, t if (k + t) % 5 else None, "user" if (k * t) % 3 else None, None if (k + 2 * t) % 4 == 0 else "x" * (37 * k * t % 600)) for k in range(60) for t in range(5)]
ODD += [(100, t, "user", None) for t in range(4)] + [(101, None, "assistant", None), (101, 0, "user", ""), (102, 0, "system", None), (103, 0, "user", ""), (104, None, "user", "ab"), (104, 3, "user", "cd")]


@pytest.mark.parametrize("name", ["escalate_prompt", "escalate_topk", "selection_events"])
def test_turns_without_text_or_place_like_sql(spark, tmp_path, name):
    spark.createDataFrame(ODD, TURNS[1]).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = c.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def page(k, head, first="Some words."):
    return k, f"https://example.com/{k}", f"<html><head><title>{head}</title></head><body><ul><li><a href='/'>{head}</a></li></ul><article><h1>{head}</h1><p>{first}</p><p>Last words.</p></article></body></html>"


HEADS = ["A &amp; B &lt;c&gt; &quot;d&quot; &#39;e&#39;", "cut off &&amp;amp", "cut off too &quot", "and at &am", "&copy 2024 &lt x"]
PAGES = ([page(k, h) for k, h in enumerate(HEADS)] + [page(9, "Plain", "* words that start like an item")], "page_id long, url string, html string")


@pytest.mark.parametrize("name", ["html_blocks", "html_outline", "html_payload", "html_title"])
def test_references_read_like_sql(spark, tmp_path, name):
    got, want = against_sql(spark, tmp_path, name, pages=PAGES)
    assert got == want
