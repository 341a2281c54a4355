"""Layout: reading order, labels, confidences and threshold calibration of boxes."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: thresholds and weights of the layout rules
START, LOW, LEAST, MOST = 0.35, 0.6, 0.05, 0.95
BATCH = 32


def _clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def with_boxes(candidates: DataFrame) -> DataFrame:
    """x0..y1 from the column bbox; without a box, a line of height 10 at the row's place."""
    order = F.col("order_hint").cast("double")
    rest = {"x0": F.lit(0.0), "y0": order * 10, "x1": F.lit(100.0), "y1": order * 10 + 10}
    return candidates.select("*", *[F.coalesce(F.col(f"bbox.{k}"), v).alias(k) for k, v in rest.items()])


def label(t: Column) -> Column:
    """heading, table, figure or paragraph by area, height and aspect."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    area = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    w, h = F.greatest(w, F.lit(0.001)), F.greatest(h, F.lit(0.001))
    return F.when((area < t * 0.25) | (h < 10), "heading").when((w / h > 3) & (h > 20), "table").when(area > t * 4, "figure").otherwise("paragraph")


def confidence(t: Column, name: Column) -> Column:
    w, h = (F.greatest(F.col(f"{x}1") - F.col(f"{x}0"), F.lit(0.001)) for x in "xy")
    base = t * 0.35 + _clamp(F.col("score"), 0.0, 1.0) * 0.5 + _clamp(w / (h + 0.001), 0.0, 6.0) * 0.03
    extra = F.when(name == "heading", 0.05).when(name == "table", 0.1).when(name == "figure", -0.05).otherwise(0.0)
    return _clamp(base + extra, 0.01, 0.99)


def calibrated(mean: Column, least: Column, t: Column) -> Column:
    moved = F.when(least < t, mean * 0.6 + least * 0.4).otherwise(mean * 0.75 + t * 0.25)
    return _clamp(moved + 0.05, LEAST, MOST)


def analyze(boxes: DataFrame, threshold: float | str = START, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add order (by page, y0 to 1/1000, order_hint, x0), label, layout_confidence and centres to x0..y1, score, page, order_hint.

    Near-equal y0 are compared after rounding, as a tolerance in the comparison itself is no order.
    """
    t = F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)
    place = Window.partitionBy(*by).orderBy("page", F.round("y0", 3), "order_hint", "x0")
    out = boxes.withColumn("order", F.row_number().over(place) - 1).withColumn("label", label(t))
    out = out.withColumn("layout_confidence", confidence(t, F.col("label")))
    return out.withColumn("x_center", (F.col("x0") + F.col("x1")) / 2).withColumn("y_center", (F.col("y0") + F.col("y1")) / 2)


def _least_where(holds: Callable[[np.ndarray], np.ndarray], guess: np.ndarray) -> np.ndarray:
    """The least double at which a condition holds that holds for all larger ones, near guess; exact beyond 1e-4."""
    low, high = guess - 1e-9 * (1 + abs(guess)), guess + 1e-9 * (1 + abs(guess))
    for _ in range(80):
        mid = (low + high) / 2
        if ((high - low <= 1e-20) | (mid == low) | (mid == high)).all():
            break
        found = holds(mid)
        low, high = np.where(found, low, mid), np.where(found, mid, high)
    return high


def unsure_spans(w: np.ndarray, h: np.ndarray, score: np.ndarray, low: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Three intervals of thresholds [from, to) for each box in which its confidence is below `low`.

    A box's confidence rises with the threshold, but for two places: where it turns from a figure to a paragraph and from
    that to a heading. The ends are exact: the very doubles at which the rules of label() and confidence() change.
    """
    area = np.maximum(w, 0.0) * np.maximum(h, 0.0)
    w, h = np.maximum(w, 0.001), np.maximum(h, 0.001)
    fixed = np.clip(score, 0.0, 1.0) * 0.5, np.clip(w / (h + 0.001), 0.0, 6.0) * 0.03

    def sure(extra: float) -> np.ndarray:
        if low > 0.99:
            return np.full(len(w), np.inf)
        if low <= 0.01:
            return np.full(len(w), -np.inf)
        return _least_where(lambda t: t * 0.35 + fixed[0] + fixed[1] + extra >= low, (low - fixed[0] - fixed[1] - extra) / 0.35)

    heading = np.where(h < 10, -np.inf, _least_where(lambda t: area < t * 0.25, area * 4))
    table = (w / h > 3) & (h > 20)
    text = np.minimum(np.where(table, np.inf, _least_where(lambda t: ~(area > t * 4), area / 4)), heading)  # figures end here
    return [
        (np.full(len(w), -np.inf), np.minimum(text, np.where(table, sure(0.1), sure(-0.05)))),
        (text, np.minimum(heading, sure(0.0))),
        (heading, sure(0.05)),
    ]


def united(spans: list[tuple[float, float]]) -> list[float]:
    """Sorted ends of the union of intervals: inside between each odd one and the next."""
    edges: list[float] = []
    for lo, hi in sorted(s for s in spans if s[0] < s[1]):
        if edges and lo <= edges[-1]:
            edges[-1] = max(edges[-1], hi)
        else:
            edges += [lo, hi]
    return edges


def settled(t: float, mean: float, least: float, edges: list[float]) -> float:
    """The threshold after a batch: raised while the batch is unsure at it and it rises by over 1/1000."""
    for _ in range(64):  # each step moves by over 1/1000 within [0.05, 0.95], and geometrically
        if not bisect_right(edges, t) % 2:
            break
        up = min(max((mean * 0.6 + least * 0.4 if least < t else mean * 0.75 + t * 0.25) + 0.05, LEAST), MOST)
        if not up > t + 1e-3:
            break
        t = up
    return t


def process(candidates: DataFrame, threshold: float = START, low: float = LOW, batch: int = BATCH, section: str | None = None) -> DataFrame:
    """analyze() in batches of a document's rows, raising the threshold where a batch is unsure.

    section: a column (a page's number, say) whose values start new batches, in their order.

    A batch with a confidence below `low` is calibrated; if the threshold rises by over 1/1000 it is analysed again with the
    new one, until it rises no more; later batches of the document start from there. The threshold a document starts from
    is given, so documents are independent and results repeatable. A document's batches depend on each other, but only
    through the threshold: each batch is reduced, in any task, to the mean and least score and the edges at which it becomes
    unsure, and these small rows are gone through in order as a stream. No row holds more than one batch.
    """
    rows = with_boxes(candidates)
    within = ["doc_id", section] if section else ["doc_id"]
    part = F.floor((F.row_number().over(Window.partitionBy(*within).orderBy("order_hint")) - 1) / batch).cast("int")
    rows = rows.withColumn("batch", part)
    if section:
        rows = rows.withColumn("batch", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(section, "batch")) - 1)
    size = F.struct((F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), F.coalesce("score", F.lit(0.0)).alias("s"))
    stats = rows.groupBy("doc_id", "batch").agg(F.avg("score").alias("mean"), F.min("score").alias("least"), F.collect_list(size).alias("boxes"))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            boxes = b.column(4)
            w, h, s = (boxes.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(3))
            at = boxes.offsets.to_numpy() - boxes.offsets[0].as_py()
            spans = [(lo.tolist(), hi.tolist()) for lo, hi in unsure_spans(w, h, s, low)]
            edges = [united([x for lo, hi in spans for x in zip(lo[i:j], hi[i:j])]) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(edges, pa.list_(pa.float64()))], names=["doc_id", "batch", "mean", "least", "edges"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, t = object(), threshold
        for b in batches:
            found = []
            for d, mean, least, edges in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if d != doc:
                    doc, t = d, threshold
                if mean is not None:
                    t = settled(t, mean, least, edges)
                found.append(t)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(found, pa.float64())], names=["doc_id", "batch", "threshold"])

    small = stats.mapInArrow(reduce, "doc_id bigint, batch int, mean double, least double, edges array<double>")
    found = small.repartition("doc_id").sortWithinPartitions("doc_id", "batch").mapInArrow(follow, "doc_id bigint, batch int, threshold double")
    found = found.select(F.col("doc_id").alias("of_doc"), F.col("batch").alias("of_batch"), "threshold")
    met = rows.join(found, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("batch") == F.col("of_batch"))).drop("of_doc", "of_batch")
    return analyze(met, "threshold", ("doc_id", "batch"))


def merge(segments: DataFrame) -> DataFrame:
    """Write label, confidence and order into a block's type, attrs and provenance."""
    more = F.create_map(
        F.lit("layout_label"), "label", F.lit("layout_confidence"), F.col("layout_confidence").cast("string"), F.lit("layout_order"), F.col("order").cast("string"), F.lit("layout_calibrated_threshold"), F.col("threshold").cast("string")
    )
    attrs = F.map_concat(F.map_filter(F.coalesce("attrs", F.create_map().cast("map<string,string>")), lambda k, _: ~k.startswith("layout_")), more)
    out = segments.withColumn("attrs", attrs).withColumn("type", F.when(F.col("label") != "paragraph", F.col("label")).otherwise(F.col("type")))
    out = out.withColumn("confidence", F.greatest("confidence", "layout_confidence")).withColumn("prov_order", F.col("order"))
    return out.withColumn("bbox", F.struct("x0", "y0", "x1", "y1"))


class CalibrationStore:
    """Thresholds per profile in a JSON file on the driver."""

    def __init__(self, path: str):
        self.path = Path(path)

    def get(self, profile: str, default: float = START) -> float:
        known = json.loads(self.path.read_text()) if self.path.exists() else {}
        return float(known.get(profile, default))

    def feedback(self, profile: str, confidences: DataFrame) -> float:
        """Calibrate a profile from a column `confidence` and keep the result."""
        now = F.lit(self.get(profile))
        new = confidences.agg(F.avg("confidence").alias("m"), F.min("confidence").alias("l")).select(F.coalesce(calibrated(F.col("m"), F.col("l"), now), now)).first()[0]
        known = json.loads(self.path.read_text()) if self.path.exists() else {}
        self.path.write_text(json.dumps(known | {profile: new}))
        return new
