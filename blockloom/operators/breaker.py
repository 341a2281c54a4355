"""A circuit breaker over a log of calls, as a scan of all tasks: segments are maps from state to state.

The state of a key is (first, n, opened): when its streak of failures began, how long it is, and when the breaker opened last.
Calls are sorted by (key, ts, id) over all tasks by range, so a key with most calls is cut over many of them, and each task
cuts its part into segments of SEGMENT calls. A segment is summed up as a map:

- where a success, or a pause that outlasts recovery and window, lies in it, whatever was before is forgotten: the map is a
  constant, found by walking the segment from its last such call only;
- else all its calls are failures, and the map is those calls' times, walked when the state before it is known.

Maps are applied in order along each key: this reads a constant per segment, and times only of segments without any reset.
Then all segments are walked at once, each from its own state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import written

#: Calls of a segment.
SEGMENT = 16384

State = tuple[float | None, int, float | None]
CLOSED: State = (None, 0, None)


def step(state: State, ts: float, ok: bool, failures: int, window: float, recovery: float) -> State:
    """The state after a call. A success closes the breaker; `failures` in a streak that began `window` ago at most open it for `recovery`."""
    first, n, opened = state
    if opened is not None and ts - opened >= recovery:
        first, n, opened = CLOSED
    if ok:
        return CLOSED
    first, n = (ts, 1) if first is None or ts - first > window else (first, n + 1)
    return first, n, ts if n >= failures else opened


def walk(state: State, times: Iterable[float], oks: Iterable[bool], **rule) -> list[State]:
    out = []
    for ts, ok in zip(times, oks):
        state = step(state, ts, ok, **rule)
        out.append(state)
    return out


def last_reset(times: np.ndarray, oks: np.ndarray, window: float, recovery: float) -> int | None:
    """Index of the last call whose state doesn't depend on what was before the segment, and from which one can walk; None if there is none.

    A success is one; so is a call after a pause that is longer than the window and no shorter than the recovery.
    """
    pause = np.diff(times)
    at = np.flatnonzero(oks | np.concatenate(([False], (pause > window) & (pause >= recovery))))
    return int(at[-1]) if len(at) else None


def summary(times: np.ndarray, oks: np.ndarray, **rule) -> State | None:
    """The state that a segment leaves, if it is the same whatever it began with."""
    at = last_reset(times, oks, rule["window"], rule["recovery"])
    return None if at is None else walk(CLOSED, times[at:].tolist(), oks[at:].tolist(), **rule)[-1]


_LEFT = "left_first double, left_n bigint, left_opened double"
_ID = "part int, seg int"


def _segments(rows: DataFrame, kind: str, rule: dict) -> DataFrame:
    """One row per segment: its calls as arrays, whether its map is constant, and then the state it leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg, held = TaskContext.get().partitionId(), 0, None

        def out(key: pa.Array, rows: pa.RecordBatch) -> pa.RecordBatch:
            left = summary(rows.column(1).to_numpy(), rows.column(3).to_numpy(zero_copy_only=False), **rule)
            lists = [pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), pa.concat_arrays([rows.column(k)])) for k in (1, 2, 3)]
            ends = left or (None, None, None)
            cols = [key, pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([left is not None]), pa.array([ends[0]], pa.float64()), pa.array([ends[1]], pa.int64()), pa.array([ends[2]], pa.float64()), *lists]
            return pa.RecordBatch.from_arrays(cols, names=["key", "part", "seg", "known", "left_first", "left_n", "left_opened", "ts", "id", "ok"])

        for b in batches:
            t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
            if not t.num_rows:
                continue
            rows = t.to_batches(max_chunksize=t.num_rows)[0]
            keys = rows.column(0)
            codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            held = None
            for i, j in zip(cuts, cuts[1:]):
                while j - i >= SEGMENT or (j < len(codes) and j > i):
                    n = min(SEGMENT, j - i)
                    yield out(keys[i : i + 1], rows.slice(i, n))
                    seg, i = seg + 1, i + n
                if j == len(codes) and j > i:
                    held = rows.slice(i)
        if held is not None:
            yield out(held.column(0)[:1], held)

    schema = f"key {kind}, {_ID}, known boolean, {_LEFT}, ts array<double>, id array<bigint>, ok array<boolean>"
    return written(rows.mapInArrow(run, schema))


def _entries(segments: DataFrame, kind: str, rule: dict) -> DataFrame:
    """(part, seg, first, n, opened): the state before each segment, by applying the maps of a key in order, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), CLOSED
        for b in batches:
            found = []
            for r in b.to_pylist():
                if r["key"] != key:
                    key, state = r["key"], CLOSED
                found.append((r["part"], r["seg"], *state))
                if r["known"]:
                    state = (r["left_first"], r["left_n"], r["left_opened"])
                else:
                    state = walk(state, r["times"], [False] * len(r["times"]), **rule)[-1]
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], names=["part", "seg", "first", "n", "opened"])

    maps = segments.select("key", "part", "seg", "known", "left_first", "left_n", "left_opened", F.when(~F.col("known"), F.col("ts")).alias("times"))
    return maps.repartition("key").sortWithinPartitions("key", "part", "seg").mapInArrow(run, f"{_ID}, first double, n bigint, opened double")


def breaker(calls: DataFrame, failures: int = 3, window: float = 10.0, recovery: float = 30.0) -> DataFrame:
    """(key, id, open_after) of calls (key, ts seconds, id, ok): whether a circuit breaker stands open after each call.

    A success resets. A failure beyond `window` of the streak's first starts a new streak; `failures` in one streak open it
    for `recovery`, and each further failure opens it again. Calls of one time go by id. A null ok is a failure; a null key is
    a key of its own; calls without a time are left out. An empty log gives no rows.
    """
    rule = {"failures": failures, "window": window, "recovery": recovery}
    rows = calls.select("key", F.col("ts").cast("double").alias("ts"), F.col("id").cast("bigint").alias("id"), F.coalesce("ok", F.lit(False)).alias("ok")).where("ts is not null")
    kind = rows.schema["key"].dataType.simpleString()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segments = _segments(rows.repartitionByRange(parts, "key", "ts", "id").sortWithinPartitions("key", "ts", "id"), kind, rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                times, ids, oks = (b.column(c)[k].values for c in (1, 2, 3))
                begun = tuple(b.column(c)[k].as_py() for c in (4, 5, 6))
                states = walk(begun, times.to_pylist(), oks.to_pylist(), **rule)
                key = pa.concat_arrays([b.column(0)[k : k + 1]]).take(pa.array(np.zeros(len(ids), np.int64)))
                yield pa.RecordBatch.from_arrays([key, ids, pa.array([opened is not None for _, _, opened in states])], names=["key", "id", "open_after"])

    met = segments.join(_entries(segments, kind, rule), ["part", "seg"])
    return met.select("key", "ts", "id", "ok", "first", "n", "opened").mapInArrow(run, f"key {kind}, id bigint, open_after boolean")
