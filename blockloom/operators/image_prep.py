"""Preparation of images for recognition: upright, grey, more contrast, black and white, straightened.

A task decodes a file into scan lines; everything after that is DataFrame work on lines (doc_id, y, px), px being grey values
of 0 to 255. Per-image figures are sums over lines; a skewed image is straightened by pieces of lines, never pixel by pixel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.images import exif, png_chunks
from ..workspace import written

# fixed values: weights of red, green and blue in 1/65536, and the contrast factor 1.4 as a fraction
GREY = np.array([19595, 38470, 7471])
GAIN, PER = 7, 5
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
VALUES = 256
#: Largest shear looked for, in rows over an image's whole width; lines that are decoded at a time, and about how many pixels
#: go on or are counted at a time.
MOST_SHEAR, LINES, PIXELS = 8, 256, 1 << 20
NAMES = ["doc_id", "y", "turned", "last", "px", "error"]
LINE = "doc_id bigint, y int, turned int, last int, px array<int>, error string"


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A scan line as the PNG format defines its five filters; step is the bytes of a pixel."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).ravel()
    if kind == 2:
        return line + above
    out = [0] * step + line.tolist()
    up = [0] * step + above.tolist()
    for i in range(step, len(out)):
        a, b, c = out[i - step], up[i], up[i - step]
        if kind == 3:
            guess = (a + b) // 2
        else:
            pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
        out[i] = (out[i] + guess) & 255
    return np.array(out[step:], np.uint8)


def _head(data: bytes) -> tuple[int, np.ndarray | None, bytes | None, bytes]:
    """Orientation, palette, header and packed samples of a PNG; ValueError for another file."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    turned, palette, header, packed = 1, None, None, []
    for kind, body in png_chunks(data):
        if kind == b"IHDR":
            header = body
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"eXIf":
            turned = exif(body)[1]
        elif kind == b"IDAT":
            packed.append(body)
    return turned, palette, header, b"".join(packed)


def _lines(palette: np.ndarray | None, header: bytes | None, rest: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(width, height, grey values of some lines) in order, for 8 bits a sample and no interlacing; ValueError for others."""
    if header is None or len(header) < 13 or header[8] != 8 or header[12] or header[9] not in CHANNELS or (header[9] == 3 and palette is None):
        raise ValueError("a kind of PNG that is not read")
    width, height, step = int.from_bytes(header[:4], "big"), int.from_bytes(header[4:8], "big"), CHANNELS[header[9]]
    inflate, above = zlib.decompressobj(), np.zeros(width * step, np.uint8)
    need, held, left = width * step + 1, b"", height
    while left:
        while len(held) < need:
            more = inflate.decompress(rest, need * LINES)
            rest = inflate.unconsumed_tail
            if not more:
                raise ValueError("the image ends early")
            held += more
        n = min(left, len(held) // need)
        some = np.frombuffer(held, np.uint8, n * need).reshape(n, need)
        held, left, raw = held[n * need :], left - n, some[:, 1:]
        if some[:, 0].any():
            raw = np.empty((n, need - 1), np.uint8)
            for i in range(n):
                above = raw[i] = _unfiltered(some[i, 0], some[i, 1:], above, step)
        above = raw[-1]
        px = raw.reshape(n, width, step)
        if header[9] == 3:
            wrong = np.flatnonzero((px[:, :, 0] >= len(palette)).any(axis=1))
            if wrong.size:
                yield width, height, _grey(palette[px[: wrong[0], :, 0]])
            yield width, height, _grey(palette[px[:, :, 0]])
        else:
            yield width, height, _grey(px[:, :, :3]) if step >= 3 else px[:, :, 0].astype(np.int32)


def _grey(colour: np.ndarray) -> np.ndarray:
    return ((colour.astype(np.int64) @ GREY + 0x8000) >> 16).astype(np.int32)


def _batch(some: list[tuple]) -> pa.RecordBatch:
    """Lines from (doc_id, turned, last, places, grey values of lines of one width)."""
    keys, turned, last, y, px = zip(*some)
    n = [len(v) for v in y]
    of = np.repeat(np.arange(len(n)), n)
    ends = np.concatenate(([0], np.cumsum(np.repeat([v.shape[1] for v in px], n)))).astype(np.int32)
    values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([v.ravel() for v in px])))
    columns = [pa.array(keys, pa.int64()).take(pa.array(of)), np.concatenate(y), np.array(turned)[of], np.array(last)[of], values, pa.nulls(len(of), pa.string())]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int32()) for c in columns], names=NAMES)


def scan_lines(files: DataFrame) -> DataFrame:
    """(doc_id, y, px, error) of files (doc_id, content), upright by their EXIF orientation.

    A file that is null, broken or of another kind gives one row with y and px null and the reason in error, behind the lines
    that could be read; an image without lines gives none. Files are read twice and decoded once: images that lie on a side
    are a branch of their own, as only they are shuffled.
    """

    def run(aside: bool):
        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                some, pixels, odd = [], 0, []
                for key, data in zip(b.column(0).to_pylist(), b.column(1)):
                    turned = 1
                    try:
                        turned, *image = _head(data.as_py() or b"")
                        if (5 <= turned <= 8) != aside:
                            continue
                        at = 0
                        for width, height, px in _lines(*image):
                            y, last = np.arange(at, at + len(px)), (width if aside else height) - 1
                            at += len(px)
                            if turned in (3, 4):
                                y = last - y
                            some.append((key, turned, last, y, px[:, ::-1] if turned in (2, 3) else px))
                            pixels += px.size + len(px)
                            if pixels >= PIXELS:
                                yield _batch(some)
                                some, pixels = [], 0
                    except (ValueError, IndexError, zlib.error) as e:
                        if (5 <= turned <= 8) == aside:
                            odd.append((key, str(e)))
                if some:
                    yield _batch(some)
                if odd:
                    none = [pa.nulls(len(odd), k) for k in (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()))]
                    keys, said = zip(*odd)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *none, pa.array(said, pa.string())], names=NAMES)

        return files.select(F.col("doc_id").cast("bigint").alias("doc_id"), "content").mapInArrow(decode, LINE)

    cells = run(True).select("doc_id", "turned", "last", "y", "error", F.posexplode_outer("px").alias("x", "v"))
    column = F.transform(F.array_sort(F.collect_list(F.when(F.col("x").isNotNull(), F.struct("y", "v")))), lambda c: c["v"])
    stood = cells.groupBy("doc_id", "turned", "last", "x").agg(column.alias("px"), F.max("error").alias("error"))
    px = F.when(F.col("turned").isin(6, 7), F.reverse("px")).otherwise(F.col("px"))
    stood = stood.select("doc_id", F.when(F.col("turned").isin(7, 8), F.col("last") - F.col("x")).otherwise(F.col("x")).alias("y"), F.when(F.col("x").isNotNull(), px).alias("px"), "error")
    return run(False).select("doc_id", "y", "px", "error").unionByName(stood)


def histograms(lines: DataFrame) -> DataFrame:
    """(doc_id, counts): how many of an image's pixels have each value of 0 to 255.

    Lines of an image that meet in a batch give one row, not one per value; these are added up per image.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, values = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy()
            key, known = b.column(0).fill_null(0).to_numpy(), b.column(0).is_valid().to_numpy(zero_copy_only=False)
            i = 0
            while i < len(key):
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + PIXELS, "right")) - 1)
                starts = np.concatenate(([0], np.flatnonzero((key[i + 1 : j] != key[i : j - 1]) | (known[i + 1 : j] != known[i : j - 1])) + 1)) + i
                n = np.diff(ends[np.append(starts, j)])
                of = np.repeat(np.arange(len(n)) * VALUES, n)
                counts = np.bincount(of + values[ends[i] : ends[j]], minlength=len(n) * VALUES)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(starts)), _rows_of(counts, pa.int32())], names=["doc_id", "counts"])
                i = j

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                parts = b.column(1).flatten().flatten().to_numpy().reshape(-1, VALUES)
                counts = np.add.reduceat(parts, b.column(1).offsets.to_numpy()[:-1] - b.column(1).offsets[0].as_py(), axis=0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), _rows_of(counts, pa.int64())], names=["doc_id", "counts"])

    some = lines.where("px is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "px").mapInArrow(partial, "doc_id bigint, counts array<int>")
    return some.groupBy("doc_id").agg(F.collect_list("counts").alias("parts")).mapInArrow(whole, "doc_id bigint, counts array<bigint>")


def _rows_of(counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, counts.size + 1, VALUES, dtype=np.int32)), pa.array(counts.ravel(), kind))


def _each(found: DataFrame, f, schema: str) -> DataFrame:
    """f(counts of some images as a matrix) -> columns behind doc_id, for some images at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), LINES):
                part = b.slice(i, LINES)
                columns = f(part.column(1).flatten().to_numpy().reshape(-1, VALUES))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *names])

    names = [c.split()[0] for c in schema.split(", ")]
    return found.mapInArrow(run, f"doc_id bigint, {schema}")


def _means(counts: np.ndarray) -> np.ndarray:
    """Rounded means; -1 for an image without pixels."""
    n = counts.sum(axis=1)
    return np.where(n > 0, np.floor(counts @ np.arange(VALUES) / np.maximum(n, 1) + 0.5), -1).astype(np.int64)


def contrasted_histograms(found: DataFrame) -> DataFrame:
    """The histograms that contrasted's lines have, from those of the lines before."""

    def moved(counts: np.ndarray) -> list[pa.Array]:
        m = _means(counts)[:, None]
        to = np.clip((m * PER + (np.arange(VALUES) - m) * GAIN) // PER, 0, VALUES - 1) + np.arange(len(counts))[:, None] * VALUES
        out = np.zeros(counts.size, np.int64)
        np.add.at(out, to.ravel(), counts.ravel())
        return [_rows_of(out, pa.int64())]

    return _each(found, moved, "counts array<bigint>")


def otsu(found: DataFrame) -> DataFrame:
    """(doc_id, threshold, dark, total) of histograms: Otsu's threshold, how many pixels it makes dark, and the sum of all values.

    Values up to the threshold are dark. The least of equally good thresholds is taken; an image of one value has none (null)
    and nothing dark.
    """

    def best(counts: np.ndarray) -> list[pa.Array]:
        upto, sums = np.cumsum(counts, axis=1), np.cumsum(counts * np.arange(VALUES), axis=1)
        nb, sb, nn, ss = upto.astype(float), sums.astype(float), upto[:, -1:].astype(float), sums[:, -1:].astype(float)
        fits = (counts > 0) & (nb < nn)
        apart = np.where(fits, (ss * nb - nn * sb) ** 2 / np.where(fits, nb * (nn - nb), 1), -1)
        t, none = apart.argmax(axis=1), ~fits.any(axis=1)
        dark = np.where(none, 0, np.take_along_axis(upto, t[:, None], 1)[:, 0])
        return [pa.array(t, pa.int32(), mask=none), pa.array(dark, pa.int64()), pa.array(sums[:, -1], pa.int64())]

    return _each(found, best, "threshold int, dark bigint, total bigint")


def contrasted(lines: DataFrame) -> DataFrame:
    """Lines with each value's distance from its image's rounded mean times 1.4, cut to 0 to 255."""
    mean = _each(histograms(lines), lambda counts: [pa.array((m := _means(counts)), pa.int32(), mask=m < 0)], "mean int")
    m = F.col("mean")
    moved = F.transform("px", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((m * PER + (v - m) * GAIN) / PER).cast("int"))))
    return lines.join(mean, "doc_id", "left").withColumn("px", moved).drop("mean")


def thresholds(lines: DataFrame) -> DataFrame:
    """(doc_id, threshold) by Otsu's rule: values up to it are dark. An image of one value has none (null)."""
    return otsu(histograms(lines)).select("doc_id", "threshold")


def binarised(lines: DataFrame) -> DataFrame:
    """Lines in 0 and 255 by their image's threshold; an image of one value is all white."""
    t = F.col("threshold")
    return lines.join(thresholds(lines), "doc_id", "left").withColumn("px", F.transform("px", lambda v: F.when(v <= t, 0).otherwise(255))).drop("threshold")


def _pieces(lines: DataFrame, w: Column) -> DataFrame:
    """Lines of w pixels cut in |shear| steps, each of which comes one row higher or lower: (..., j, at, n, to), `to` the new row.

    One step, with either sign, leaves a line as it is.
    """
    steps = F.greatest(F.abs("shear"), F.lit(1))
    cut = lines.withColumn("j", F.explode(F.sequence(F.lit(0), steps - 1)))

    def edge(j: Column) -> Column:
        return F.ceil(j * w / steps).cast("int")

    return cut.withColumns({"at": edge(F.col("j")), "n": edge(F.col("j") + 1) - edge(F.col("j")), "to": F.col("y") - F.signum("shear").cast("int") * F.col("j")})


def _cuts(w: int, most: int) -> tuple[np.ndarray, ...]:
    """For all pieces of all shears: number of the shear, first pixel, pixel behind the last, and rows to go up."""
    every = []
    for k, shear in enumerate(range(-most, most + 1)):
        steps = max(abs(shear), 1)
        every += [(k, -(-j * w // steps), -(-(j + 1) * w // steps), int(np.sign(shear)) * j) for j in range(steps)]
    return tuple(np.array(every).T)


def skews(lines: DataFrame, most: int = MOST_SHEAR) -> DataFrame:
    """(doc_id, shear) of lines in 0 and 255: in how many steps of a row text lines fall from left to right (rise: below 0).

    For each shear the dark pixels are counted by the row they would come to, piece by piece; the sharpest profile (largest sum
    of squares) wins, the smallest shear among equals. Lines of an image that meet in a batch give one row of partial
    profiles, which are added up per image; lines may come in any order.
    """
    shears = 2 * most + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for b in batches:
            key, y, ends = b.column(0).to_pylist(), b.column(1).to_numpy().astype(np.int64), b.column(2).offsets.to_numpy()
            dark = np.concatenate(([0], np.cumsum(b.column(2).values.to_numpy() == 0)))  # up to each pixel of the batch
            run = [0] + [i for i in range(1, len(key)) if key[i] != key[i - 1] or ends[i + 1] - ends[i] != ends[i] - ends[i - 1] or abs(y[i] - y[i - 1]) > 2 * most] + [len(key)]
            rows = []
            for i, j in zip(run, run[1:]):
                if i == j:
                    continue
                w = int(ends[i + 1] - ends[i])
                if w not in known:
                    known[w] = _cuts(w, most)
                which, first, behind, up = known[w]
                n = dark[ends[i:j, None] + behind] - dark[ends[i:j, None] + first]
                to = y[i:j, None] - up
                low, span = int(to.min()), int(to.max() - to.min()) + 1
                rows.append((key[i], low, np.bincount((which * span + to - low).ravel(), n.ravel(), shears * span).astype(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["doc_id", "low", "counts"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for parts in b.column(1):
                some = [(p["low"].as_py(), p["counts"].values.to_numpy().reshape(shears, -1)) for p in parts]
                low = min(k for k, _ in some)
                rows = np.zeros((shears, max(k + c.shape[1] for k, c in some) - low), np.int64)
                for k, c in some:
                    rows[:, k - low : k - low + c.shape[1]] += c
                score = (rows * rows).sum(axis=1).tolist()
                found.append(max(range(-most, most + 1), key=lambda s: (score[s + most], -abs(s), s)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int32())], names=["doc_id", "shear"])

    some = lines.where("px is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "y", "px").mapInArrow(partial, "doc_id bigint, low bigint, counts array<bigint>")
    return some.groupBy("doc_id").agg(F.collect_list(F.struct("low", "counts")).alias("parts")).mapInArrow(best, "doc_id bigint, shear int")


def straightened(lines: DataFrame, most: int = MOST_SHEAR) -> DataFrame:
    """Lines in 0 and 255 with their image's shear undone. No pixel is lost: an image gets as many more rows, white elsewhere."""
    bent = lines.join(skews(lines, most), "doc_id", "left").withColumn("shear", F.coalesce("shear", F.lit(0)))
    odd = bent.where("px is null").select("doc_id", "y", "px", "error")
    cut = _pieces(bent.where("px is not null"), F.size("px")).withColumn("piece", F.slice("px", F.col("at") + 1, F.col("n")))
    lift = F.greatest(F.col("shear"), F.lit(1)) - 1  # the highest row a piece may come to is -lift
    rows = cut.groupBy("doc_id", (F.col("to") + lift).alias("y"), "shear", F.size("px").alias("w")).agg(F.map_from_entries(F.collect_list(F.struct("j", "piece"))).alias("pieces"))
    steps = F.greatest(F.abs("shear"), F.lit(1))

    def part(j: Column) -> Column:
        n = F.ceil((j + 1) * F.col("w") / steps) - F.ceil(j * F.col("w") / steps)
        return F.coalesce(F.col("pieces")[j], F.array_repeat(F.lit(255), n.cast("int")))

    return rows.select("doc_id", "y", F.flatten(F.transform(F.sequence(F.lit(0), steps - 1), part)).alias("px"), F.lit(None).cast("string").alias("error")).unionByName(odd)


def prepared(files: DataFrame, straighten: bool = True) -> DataFrame:
    """(doc_id, image, error): each file's image, prepared, as a binary PGM; null where error says why it couldn't be read.

    Lines are written to the shared folder once decoded and once more in black and white, as later steps read them repeatedly.
    """
    lines = written(binarised(contrasted(written(scan_lines(files)))))
    lines = straightened(lines) if straighten else lines
    hexed = F.array_join(F.transform("px", lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0")), "")
    whole = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("px").isNotNull(), F.struct("y", hexed.alias("h"))))).alias("rows"), F.max(F.size("px")).alias("w"), F.max("error").alias("error"))
    head = F.concat(F.lit("P5\n"), "w", F.lit(" "), F.size("rows"), F.lit("\n255\n")).cast("binary")
    image = F.concat(head, F.unhex(F.array_join(F.transform("rows", lambda r: r["h"]), "")))
    return whole.select("doc_id", F.when(F.col("error").isNull(), image).alias("image"), "error")
