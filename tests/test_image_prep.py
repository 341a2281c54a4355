import struct
import zlib

import numpy as np

from blockloom.operators import image_prep as prep

FILES = "doc_id long, content binary, extra string"


def png(px, kind=0, filters=None, orientation=1, palette=None):
    """A PNG of rows of samples, each row with a filter of its own."""
    px = np.asarray(px, np.uint8)
    h, w, step = px.shape if px.ndim == 3 else (*px.shape, 1)
    flat = px.reshape(h, w * step).astype(int)
    rows = []
    for y in range(h):
        f = filters[y % len(filters)] if filters else 0
        out = []
        for i in range(w * step):
            a = flat[y, i - step] if i >= step else 0
            b = flat[y - 1, i] if y else 0
            c = flat[y - 1, i - step] if y and i >= step else 0
            paeth = min((a, b, c), key=lambda v: abs(a + b - c - v))
            out.append((flat[y, i] - (0, a, b, (a + b) // 2, paeth)[f]) % 256)
        rows.append(bytes([f, *out]))
    chunks = [(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0))]
    if palette is not None:
        chunks.append((b"PLTE", bytes(np.asarray(palette, np.uint8).ravel())))
    if orientation != 1:
        chunks.append((b"eXIf", b"II*\0" + struct.pack("<IHHHIHHI", 8, 1, 0x0112, 3, 1, orientation, 0, 0)))
    packed = zlib.compress(b"".join(rows))
    chunks += [(b"IDAT", packed[:20]), (b"IDAT", packed[20:]), (b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in chunks)


def arrays(df):
    found = {}
    for r in df.orderBy("doc_id", "y").collect():
        found.setdefault(r.doc_id, []).append(r.px)
    return {k: np.array(v) for k, v in found.items()}


def test_scan_lines_of_all_kinds_and_turns(spark):
    rng = np.random.default_rng(1)
    grey, rgb, rgba = rng.integers(0, 256, (7, 5)), rng.integers(0, 256, (6, 4, 3)), rng.integers(0, 256, (3, 9, 4))
    palette = rng.integers(0, 256, (16, 3))
    indexed = rng.integers(0, 16, (4, 6))
    luma = lambda c: (c.astype(np.int64) @ prep.GREY + 0x8000) >> 16
    every = [0, 1, 2, 3, 4]
    rows = [(0, png(grey, filters=every)), (1, png(rgb, 2, every)), (2, png(rgba, 6, every[::-1])), (3, png(indexed, 3, palette=palette))]
    upright = {2: np.fliplr, 3: lambda g: np.rot90(g, 2), 4: np.flipud, 5: np.transpose, 6: lambda g: np.rot90(g, -1), 7: lambda g: np.rot90(g.T, 2), 8: np.rot90}
    rows += [(10 + o, png(grey, orientation=o)) for o in upright]
    got = arrays(prep.scan_lines(spark.createDataFrame([(*r, "x") for r in rows], FILES).repartition(3)))
    want = {0: grey, 1: luma(rgb), 2: luma(rgba[:, :, :3]), 3: luma(palette[indexed])} | {10 + o: f(grey) for o, f in upright.items()}
    assert got.keys() == want.keys() and all(np.array_equal(got[k], want[k]) for k in want)


def test_preparation_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    images = {k: np.clip(rng.normal(120 + 60 * (rng.random((20, 30)) < 0.4) * (-1) ** k, 15), 0, 255).astype(int) for k in range(4)}
    images[9] = np.full((3, 4), 77)
    files = spark.createDataFrame([(k, png(v), "x") for k, v in images.items()], FILES)
    lines = prep.contrasted(prep.scan_lines(files))
    strong = {k: np.clip(np.floor((5 * (m := int(v.mean() + 0.5)) + 7 * (v - m)) / 5), 0, 255).astype(int) for k, v in images.items()}
    got = arrays(lines)
    assert all(np.array_equal(got[k], strong[k]) for k in images)

    def otsu(v):
        best = None
        for t in sorted(set(v.ravel()))[:-1]:
            low, high = v[v <= t], v[v > t]
            score = low.size * high.size * (low.mean() - high.mean()) ** 2
            if best is None or score > best[0] * (1 + 1e-12):
                best = score, t
        return None if best is None else best[1]

    assert {r.doc_id: r.threshold for r in prep.thresholds(lines).collect()} == {k: otsu(v) for k, v in strong.items()}
    black = arrays(prep.binarised(lines))
    assert (black[9] == 255).all() and np.array_equal(black[0], np.where(strong[0] <= otsu(strong[0]), 0, 255))


def test_straightened(spark):
    def text(shear, h=30, w=40):
        x, y = np.meshgrid(np.arange(w), np.arange(h))
        row = y - np.sign(shear) * (x * abs(shear) // w)
        return np.where((row % 6 < 2) & (row > 6) & (row < h - 7), 30, 220)

    shears = [-5, -1, 0, 1, 3, 7]
    files = spark.createDataFrame([(s, png(text(s)), "x") for s in shears], FILES)
    lines = prep.binarised(prep.contrasted(prep.scan_lines(files)))
    assert {r.doc_id: r.shear for r in prep.skews(lines).collect()} == {s: s if abs(s) > 1 else 0 for s in shears}  # one step is none
    before, after = arrays(lines), arrays(prep.straightened(lines))
    for s in shears:
        dark = (after[s] == 0).sum(axis=1)
        assert after[s].shape == (30 + max(0, abs(s) - 1), 40) and dark.sum() == (before[s] == 0).sum()
        assert set(dark.tolist()) <= {0, 40}  # whole lines


def test_odd_files(spark):
    whole = png(np.full((5, 5), 9))
    rows = [(1, None), (2, b""), (3, b"GIF89a"), (4, whole[:45]), (5, whole[:8]), (6, png(np.zeros((2, 2)), kind=3)), (7, png([[0, 255]])), (None, png([[1]]))]
    got = {r.doc_id: r for r in prep.prepared(spark.createDataFrame([(*r, "x") for r in rows], FILES)).collect()}
    assert got.keys() == {1, 2, 3, 4, 5, 6, 7, None}
    assert all(got[k].image is None and got[k].error for k in (1, 2, 3, 4, 5, 6))
    assert bytes(got[7].image) == b"P5\n2 1\n255\n\x00\xff" and bytes(got[None].image) == b"P5\n1 1\n255\n\xff"
    assert prep.prepared(spark.createDataFrame([], FILES)).count() == 0


def test_skew_search_makes_no_row_per_piece(spark):
    """One row of profiles per image and batch; lines in any order, far apart or dealt out give the same."""
    x, y = np.meshgrid(np.arange(40), np.arange(30))
    px = np.where(((y - x * 5 // 40) % 6 < 2) & (y > 12) & (y < 23), 0, 255)
    rows = [(k, int(i * gap), px[i].tolist()) for k, gap in ((1, 1), (2, 1), (None, 1)) for i in np.random.default_rng(k).permutation(30)]
    rows += [(4, 10**6 * i, px[i].tolist()) for i in range(30)] + [(5, 0, []), (6, 3, None)]
    lines = spark.createDataFrame(rows, "doc_id long, y int, px array<int>").repartition(3)
    found = prep.skews(lines)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.shear for r in found.collect()} == {1: 5, 2: 5, None: 5, 4: 0, 5: 0}


def test_images_are_made_on_all_cores(spark):
    from blockloom.plans.source_queries import _pngs

    assert _pngs(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_histograms_make_no_row_per_pixel(spark):
    """Threshold, dark pixels and sum from histograms equal those of the lines, in whatever order and batches these come."""
    rng = np.random.default_rng(3)
    images = {k: rng.choice(rng.integers(0, 256, 2 + k * 5), (9, 7)) for k in range(12)} | {None: rng.integers(90, 120, (4, 3)), 20: np.full((2, 2), 5)}
    rows = [(k, int(y), v[y].tolist()) for k, v in images.items() for y in range(len(v))]
    rows = [rows[i] for i in rng.permutation(len(rows))] + [(21, None, None), (22, 0, [])]
    lines = spark.createDataFrame(rows, "doc_id long, y int, px array<int>").repartition(3)
    found = prep.otsu(prep.contrasted_histograms(prep.histograms(lines)))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    strong = {k: np.clip(np.floor((5 * (m := int(v.mean() + 0.5)) + 7 * (v - m)) / 5), 0, 255).astype(int) for k, v in images.items()}
    got = {r.doc_id: (r.threshold, r.dark, r.total) for r in found.collect()}
    black = arrays(prep.binarised(prep.contrasted(lines.where("doc_id is not null and doc_id < 21"))))
    assert got.keys() == {*images, 22} and got[20][:2] == (None, 0) and got[22] == (None, 0, 0)
    assert all(got[k][2] == v.sum() for k, v in strong.items())
    assert all(got[k][1] == (black[k] == 0).sum() == (strong[k] <= got[k][0]).sum() for k in range(12))


def test_image_threshold_decodes_once(spark, monkeypatch):
    """Files are written before their two branches read them, and no line is written or shuffled."""
    from blockloom.plans import source_queries

    made = []
    monkeypatch.setattr(source_queries, "written", lambda df: made.append(df.columns) or df)
    plan = source_queries.image_threshold(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert made == [["doc_id", "content"]] and "Join" not in plan and "Window" not in plan
