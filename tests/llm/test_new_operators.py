"""Centroid clustering, the conversation trie and the n-gram join against brute force, on odd rows and with small bounds."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.llm import batches, centroids, common, exact_dedup, ngram_join, pii, prefix_trie, scans, simhash, url_filter

# centroid clustering

VECTORS = "vec_id long, embedding array<float>, row long, owner int, cluster string"


def lloyd(rows, k, rounds, scale):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows]
    start = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    c = [v for _, v in start[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in kept:
            of[near(v)[1]].append(v)
        c = [[sum(x) // len(of[j]) for x in zip(*of[j])] if of[j] else m for j, m in enumerate(c)]
    most = 2**63 - 1  # all longs saturate
    found = [(i, min(d, most), j) for i, v in kept for d, j in [near(v)]]
    own = defaultdict(int)
    for _, d, j in found:
        own[j] += d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, j, d, min(own[j], most), min(sum(own.values()), most), sha[j]) for i, d, j in found), key=repr)


@pytest.mark.parametrize("seed,scale,k", [(2, 1024.0, 5), (3, 1.0, 4), (4, 1e12, 3)])
def test_clusters(spark, seed, scale, k):
    r = np.random.default_rng(seed)
    rows = [(i, r.normal(r.integers(0, 4), 0.4, 6).round(2).tolist()) for i in range(150)]
    rows += [(7, rows[7][1])] * 40 + [(None, rows[3][1])] * 3  # repeats, ties and null ids
    odd = [(900, None), (901, [None] + [1.0] * 5), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [1.0] * 5), (905, [])]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows + odd], VECTORS)
    got = centroids.clusters(df, k=k, rounds=5, dims=6, scale=scale)
    assert sorted(map(tuple, got.collect()), key=repr) == lloyd(rows, k, 5, scale)


def test_clusters_edges(spark):
    few = spark.createDataFrame([(1, [0.0, 1.0]), (2, [5.0, 1.0])], "vec_id long, embedding array<float>")
    assert centroids.clusters(few, k=8, dims=2).count() == 2
    assert centroids.clusters(few.limit(0), k=8, dims=2).count() == 0
    huge = spark.createDataFrame([(1, [1e30, -1e30]), (2, [-1e30, 1e30]), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in centroids.clusters(huge, k=1, dims=2).collect()}
    assert got[1].distance == 2**63 - 1 == got[1].inertia
    with pytest.raises(ValueError):
        centroids.cluster(few, k=1 << 20, dims=64)


def test_few_comparisons():
    """Rows whose own centroid stayed are compared with the changed ones only, and the result is that of all of them."""
    r = np.random.default_rng(5)
    v, c = r.integers(-50, 50, (400, 3)), r.integers(-50, 50, (6, 3))
    owner, distance = centroids.nearest(v, np.full(400, -1), np.zeros(400, np.int64), c, np.ones(6, bool))
    moved = c.copy()
    moved[[1, 4]] += r.integers(-9, 9, (2, 3))
    changed = np.array([False, True, False, False, True, False])
    got = centroids.nearest(v, owner, distance, moved, changed)
    want = centroids.nearest(v, np.full(400, -1), np.zeros(400, np.int64), moved, np.ones(6, bool))
    assert all((a == b).all() for a, b in zip(got, want))


# conversation trie


def trie_brute(rows, group=5, heads=9):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            w = (role or "", text or "")
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(w[0].encode())}:{w[0]}{w[1]}".encode()).digest()[:16], w))
    turns = {c: [w for *_, w in sorted(ws, key=lambda x: (x[0], x[1], np.frombuffer(x[2], ">i8").tolist()))] for c, ws in own.items()}
    full = {}
    for c, ws in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - int(math.fmod(c, group))
        full[c] = tuple(turns.get(base, [])[:h] + ws[h:])
    members = defaultdict(list)
    for c, ws in full.items():
        for d in range(len(ws) + 1):
            members[ws[:d]].append(c)
    out = []
    for path, m in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(q[: len(p)] == p and len(q) > len(p) for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in m if full[c] == path)))
        up = min(members[path[:-1]]) if path else None
        out.append((min(m), len(path), up, len(m), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


CONV = "conv_id long, turn long, role string, text string, depth int, path string, part int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], CONV)


def trie_of(df):
    return sorted(map(tuple, prefix_trie.trie(df).drop("preorder").collect()), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_trie(spark, seed):
    r = np.random.default_rng(seed)
    rows = []
    for c in r.choice(np.arange(-12, 60), 40, replace=False).tolist():
        rows += [(c, t, ["user", "bot", None][r.integers(0, 3)], ["a", "bé", "", None][r.integers(0, 4)]) for t in range(r.integers(0, 13))]
    rows += [(3, None, "user", "first"), (3, 1, "user", "tie"), (3, 1, "bot", "tie"), (None, 0, "user", "lost")]
    rows += [(61, t, "user", f"long {t % 7}") for t in range(80)]
    rows += [rows[5]] * 6
    assert trie_of(conversations(spark, rows)) == trie_brute(rows)


def test_trie_shapes(spark):
    """Combs, in which every conversation goes one turn further than another; copies; one conversation with most rows."""
    rows = [(5 * c, t, "u", f"t{t}") for c in range(30) for t in range(c + 1)]
    rows += [(5 * (99 - c), t, "v", f"t{t}") for c in range(30) for t in range(c + 1)]
    rows += [(1000, t, "u", str(t % 3)) for t in range(400)] + [(5 * c, t, "u", "same") for c in range(220, 260) for t in range(3)]
    got = prefix_trie.trie(conversations(spark, rows)).collect()
    assert sorted((tuple(r)[:-1] for r in got), key=repr) == trie_brute(rows)
    order = sorted(got, key=lambda r: r.preorder)
    assert [r.preorder for r in order] == list(range(len(order))) and order[0].depth == 0
    assert all(b.depth <= a.depth + 1 for a, b in zip(order, order[1:]))
    assert trie_of(conversations(spark, [])) == []


def test_trie_clash(spark, monkeypatch):
    """With factors under which prefixes clash, others are taken; with no others it says so."""
    rows = [(5 * c, t, "u", w) for c, ws in enumerate(["abc", "acb", "bca", "cab"]) for t, w in enumerate(ws * 4)]
    good = prefix_trie.FACTORS[0]
    monkeypatch.setattr(prefix_trie, "FACTORS", [(1, 1), good])
    assert trie_of(conversations(spark, rows)) == trie_brute(rows)
    monkeypatch.setattr(prefix_trie, "FACTORS", [(1, 1)])
    with pytest.raises(ValueError):
        trie_of(conversations(spark, rows))


def test_running_sums(spark):
    rows = spark.createDataFrame([(k % 3 if k % 2 else 7, k) for k in range(500)], "key long, at long").repartition(5)
    got = sorted((r.key, r.at, r.ord) for r in scans.counted(rows, "key", "at").collect())
    seen = defaultdict(int)
    for key, at, n in got:
        seen[key] += 1
        assert n == seen[key]
    total = 0
    for r in sorted(scans.summed(rows, ["at"], "key", "at").collect()):
        assert r.at_before == total
        total += r.at


# n-gram join


def join_brute(rows):
    sets = []
    for _, t in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ")
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[find(k)].append(i)
    return sorted(((i, len(sets[k]), min((x for x in ids[find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)), key=repr)


def corpus(seed):
    r = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in r.integers(0, 5000, n)]
    shared = word(40)
    texts = ["", None, " \t", "one", "One", "a b c d", "A b  c\td", "a b c d e", "é ü 中 😀 a", "x " * 300, "same same same same same same"]
    texts += [" ".join(word(30) + shared + word(5)) for _ in range(12)]  # a shared passage links nothing
    for _ in range(8):
        base = word(int(r.integers(20, 120)))
        for _ in range(int(r.integers(2, 7))):
            copy = list(base)
            for _ in range(int(r.integers(0, 4))):
                copy[r.integers(0, len(copy))] = "edit"
            texts.append(" ".join(copy[: len(copy) - int(r.integers(0, 6))]))
    chain = word(60)
    texts += [" ".join(chain[k : k + 50]) for k in range(0, 11)]  # neighbours are similar, the ends are not
    rows = list(enumerate(texts)) + [(3, "one"), (None, "one"), (None, "lonely words that nobody else has at all"), (20, texts[20])]
    return [rows[k] for k in r.permutation(len(rows))]


@pytest.mark.parametrize("seed,cap,batch", [(1, 1 << 20, 1 << 25), (2, 300, 2000), (3, 60, 300)])
def test_ngram_join(spark, monkeypatch, seed, cap, batch):
    """In one tile or dealt over chunks, in one batch of texts or in many."""
    monkeypatch.setattr(ngram_join, "CAP", cap)
    monkeypatch.setattr(batches, "BATCH", batch)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "x", 3) for i, t in rows], "doc_id long, text string, row int, node string, n int")
    assert sorted(map(tuple, ngram_join.similar(df).collect()), key=repr) == join_brute(rows)
    assert ngram_join.similar(df.limit(0)).count() == 0


@pytest.mark.parametrize("merged", [0, 4096])
def test_divide_skip(monkeypatch, merged):
    """T-occurrence searches find exactly the similar sets, with and without long lists set aside."""
    monkeypatch.setattr(ngram_join, "MERGED", merged)
    r = np.random.default_rng(9)
    base = [r.choice(4000, 60, replace=False) for _ in range(5)]
    found = [np.unique(np.concatenate((b[: r.integers(45, 61)], r.integers(4000, 9000, r.integers(0, 12))))).astype(np.uint64) for b in base for _ in range(12)]
    tile = ngram_join.Tile(found)
    for x, a in enumerate(found):
        want = [y for y, b in enumerate(found) if y != x and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))]
        assert tile.partners(x, np.ones(len(found), bool)).tolist() == want


def test_squeezed():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 1000):
        v = np.unique(r.integers(1 << 33, (1 << 33) + (1 << 32) - 1, n).astype(np.uint64))
        assert (ngram_join.spread(ngram_join.squeezed(v)) == v).all()
    for size in (0, 10**3, 10**9, 10**14):
        x = ngram_join.Ranges(size, 8)
        assert x.bits - x.range_bits <= 32 and x.bits <= 64
        h = r.integers(0, 1 << 63, 50).astype(np.uint64) * np.uint64(2)
        assert x.of(x.cut(h)).max() < 1 << x.range_bits


def test_long_text(spark):
    """Texts of some megabytes are compared whole: one that differs in its last part only is no copy, one with an edit is."""
    r = np.random.default_rng(11)
    words = [f"w{x}" for x in r.integers(0, 10**6, 400_000)]
    edit = words[:200_000] + ["edit"] + words[200_001:]
    part = words[:300_000] + [f"v{x}" for x in range(100_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edit)), (3, " ".join(part))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.similar(df.withColumn("x", F.lit(1))).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


# earlier operators: identifiers of many words, hosts of many labels


def test_pii_of_many_words(spark):
    """Identifiers of more words than a candidate's parts are found whole, and no part of one is reported."""
    rows = [f"phone: +1 (017) 555-{7000 + i} ok" for i in range(200)]
    rows += [f"phone: 0{i % 10} {10 + i % 90} {20 + i % 70} 45 {30 + i % 60} ok" for i in range(60)]
    rows += [f"phone: {' '.join(str(10 + (i * k) % 90) for k in range(1, 9))} ok" for i in range(5)]
    rows += ["see 0301 44 55 66 77 88 there", "phone: " + "12 " * 3000 + "ok"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.more] for r in pii.find(df).collect()}
    for i, t in enumerate(rows[200:265], 200):
        assert got[i] == [(7, len(t) - 3)], t
    assert got[265] == []


def test_url_of_many_labels(spark):
    """A host of 200,000 labels costs no more than the lengths of the rules' hosts."""
    host = "a." * 200_000
    rows = [(1, f"http://{host}example.com/en/7x"), (2, f"http://{host}com/en/"), (3, f"http://{host}xcom/en/"), (4, "http://com./en/"), (5, f"http://{'.' * 100_000}org/es/")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {1: ("example.com/en/7", "allow"), 2: ("com/en/", "block"), 3: (None, "allow"), 4: (None, "allow"), 5: ("org/es/", "block")}


def test_marked_beyond_the_filter(spark, monkeypatch):
    """Beyond the filter's bound rows are marked by a join of numbers: exact, and no exchange carries the rows."""
    df = spark.range(2000).select("id", F.concat(F.lit("text "), F.col("id") % 700).alias("text"), F.create_map(F.lit("a"), "id").alias("m"))
    keys = spark.createDataFrame([(f"text {k}",) for k in range(0, 700, 7)] * 2, "key string")
    monkeypatch.setattr(common, "MOST_BUCKETS", 0)
    got = common.marked(df, F.col("text"), keys, "hit")
    assert got.columns == ["id", "text", "m", "hit"]
    assert sorted(r.id for r in got.where("hit").collect()) == [k for k in range(2000) if k % 700 % 7 == 0] and got.count() == 2000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan


@pytest.mark.parametrize("stage", [exact_dedup.distinct_documents, simhash.one_of_near])
def test_stages_beyond_the_filter(spark, monkeypatch, stage):
    rows = corpus(5)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row string")
    want = sorted(map(tuple, stage(df).collect()), key=repr)
    monkeypatch.setattr(common, "MOST_BUCKETS", 0)
    monkeypatch.setattr(exact_dedup, "MOST_BUCKETS", 0)
    assert sorted(map(tuple, stage(df).collect()), key=repr) == want


@pytest.mark.parametrize("parts", [1, 12])
def test_pii_parts_of_long_sequences(spark, monkeypatch, parts):
    """Phones among many other numbers are found by their shape, as if all parts of all sequences were made (parts = 12)."""
    rows = [f"phone: +1 (017) 555-{7000 + i} ok" for i in range(200)]
    rows += [f"ring: 0{i % 10}.{100 + i} ({i % 7}) ok" for i in range(40)] + [f"phone: 0{i % 10}.{100 + i} ({i % 7}) 55{1000 + i} ok" for i in range(60)]
    rows += ["see 1 22 333 4444 +1 (017) 555-8001 1234567890123456 7 88 there", "see 1 2 3 ,+1 (017) 555-8002 4 5 6 7 8 there", "see 1 2 3 04.107 (3) 551007 4 5 6 there", "see 1 2 3 4 5 6 7 8 9 there"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    with_all = lambda: {r.doc_id: [(s.start, s.end, s.kind) for s in r.more] for r in pii.find(df).collect() if r.more}
    got = with_all()
    monkeypatch.setattr(pii, "PARTS", parts)
    assert got == with_all()
    assert [rows[k][s:e] for k in (300, 301, 302) for s, e, _ in got[k]] == ["+1 (017) 555-8001", "+1 (017) 555-8002", "04.107 (3) 551007"] and 303 not in got


def test_pii_parts_in_a_long_table_of_numbers(spark):
    """A sequence of thousands of words: parts are tried by hashes of shapes, and only those met are made."""
    rows = [f"phone: +1 (017) 555-{7000 + i} ok" for i in range(200)] + ["see " + "12 345 " * 4000 + "+1 (017) 555-8001" + " 12 345" * 4000 + " there"]
    got = {r.doc_id: r.more for r in pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [(s.start, s.end, s.kind) for s in got[200]] == [(28004, 28021, 3)]
