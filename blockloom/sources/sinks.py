"""Sinks: documents and payloads as JSON lines, metrics as text."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def documents(blocks: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """One row per document with its blocks in order. Only for writing: a document's blocks are gathered here."""
    body = F.struct(*[c for c in blocks.columns if c != "doc_id"])
    out = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("_p"), body.alias("_b"))), lambda a, b: a["_p"] - b["_p"]).alias("_s"), F.count("*").alias("block_count"))
    out = out.select("doc_id", F.transform("_s", lambda x: x["_b"]).alias("blocks"), "block_count")
    return out.join(meta, "doc_id", "left") if meta is not None else out


def write_jsonl(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).json(path)


def split_errors(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(rows without an error, rows with one)."""
    return rows.where(F.col(error).isNull()).drop(error), rows.where(F.col(error).isNotNull())


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


# fixed values: counter families over the call metrics and over the kernel metrics, and the ones told apart by status
FAMILIES = {
    "llm_calls_total": "calls",
    "llm_successes_total": "successes",
    "llm_failures_total": "failures",
    "llm_latency_ms_total": "total_latency_ms",
    "llm_request_bytes_total": "request_bytes",
    "llm_response_bytes_total": "response_bytes",
}
KERNEL_FAMILIES = {"kernel_calls_total": "calls", "kernel_failures_total": "failures", "kernel_duration_ms_total": "total_ms", "kernel_units_total": "units"}
STATUS = {"success": "successes", "failure": "failures"}
HELP = {
    "kernel_calls_total": "Calls of a kernel.",
    "kernel_failures_total": "Failed calls of a kernel.",
    "kernel_duration_ms_total": "Time spent in a kernel, in milliseconds.",
    "kernel_units_total": "Units that a kernel has worked on.",
    "llm_calls_total": "Calls of a driver by status.",
    "llm_latency_ms_total": "Time spent waiting for a driver, in milliseconds.",
    "llm_request_bytes_total": "Bytes sent to a driver.",
    "llm_response_bytes_total": "Bytes received from a driver.",
}


def prometheus(metrics: DataFrame, label: str = "driver", families: dict[str, str] | None = None, labels: dict[str, str] | None = None, prefix: str = "blockloom") -> DataFrame:
    """(family, line): exposition lines of a metrics table, labels sorted by name."""
    names = sorted([label, *(labels or {})])
    value = {label: F.to_json(F.struct(F.col(label).alias("v")))} | {k: F.lit(json.dumps({"v": v}, separators=(",", ":"))) for k, v in (labels or {}).items()}
    shown = F.concat(*[x for k, n in enumerate(names) for x in (F.lit(("," if k else "{") + n + "="), F.regexp_extract(value[n], r'^\{"v":(.*)\}$', 1))], F.lit("}"))
    rows = [F.struct(F.lit(f"{prefix}_{f}").alias("family"), F.concat(F.lit(f"{prefix}_{f}"), shown, F.lit(" "), F.col(c).cast("string")).alias("line")) for f, c in (families or FAMILIES).items()]
    return metrics.select(F.explode(F.array(*rows)).alias("r")).select("r.family", "r.line")


def exposition(calls: DataFrame, kernels: DataFrame, labels: dict[str, str] | None = None, prefix: str = "blockloom") -> str:
    """All families as one text, with HELP and TYPE lines. calls and kernels: call_metrics and kernel_stats, a row for each."""
    own = labels or {}
    by_status = None
    for status, column in STATUS.items():
        part = prometheus(calls, families={"llm_calls_total": column}, labels=own | {"status": status}, prefix=prefix)
        by_status = part if by_status is None else by_status.unionByName(part)
    rest = {k: v for k, v in FAMILIES.items() if k in HELP and k != "llm_calls_total"}
    lines = prometheus(kernels, "kernel", KERNEL_FAMILIES, own, prefix).unionByName(by_status).unionByName(prometheus(calls, families=rest, labels=own, prefix=prefix))
    found: dict[str, list[str]] = {}
    for r in lines.orderBy("family", F.desc("line")).collect():  # a few rows for each driver and kernel
        found.setdefault(r.family.removeprefix(f"{prefix}_"), []).append(r.line)
    out = []
    for family, text in HELP.items():
        out += [f"# HELP {prefix}_{family} {text}", f"# TYPE {prefix}_{family} counter", *found.get(family, [])]
    return "\n".join(out) + "\n"


def snapshot(metrics: DataFrame) -> DataFrame:
    return metrics.select(F.to_json(F.struct(*metrics.columns)).alias("json"))


def metrics_event(calls: DataFrame, kernels: DataFrame, tags: dict[str, str] | None = None) -> dict:
    """Calls and kernels as one event for an error tracker."""
    rows = lambda df: [json.loads(r.json) for r in snapshot(df).collect()]  # noqa: E731  a row for each driver or kernel
    return {"level": "info", "timestamp": time.time(), "message": "blockloom metrics", "extra": {"telemetry": {"drivers": rows(calls), "kernels": rows(kernels)}}, "tags": dict(tags or {})}


def push_event(event: dict, capture=None) -> None:
    """Send an event with `capture`, by default that of the sentry_sdk package, which must be set up."""
    if capture is None:
        try:
            from sentry_sdk import capture_event as capture
        except ImportError as e:
            raise RuntimeError("the package sentry_sdk is not installed") from e
    capture(event)
