"""Command line: convert files to blocks or payloads, learn recipes, run and replay prompts, choose profiles, show metrics."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config, drivers
from .operators import control, escalation, recipes
from .plans.convert import convert
from .sources import files, payloads, sinks


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="blockloom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="files to documents of blocks, as JSON lines")
    c.add_argument("paths", nargs="*")
    c.add_argument("--paths-file")
    c.add_argument("--out", required=True)
    c.add_argument("--recipe", default="default")
    c.add_argument("--profile", default="balanced")
    c.add_argument("--driver")
    c.add_argument("--ignore-glob")
    c.add_argument("--no-llm", action="store_true")
    c.add_argument("--state", help="file of recorded outcomes, for the profile auto")
    c.add_argument("--visual", action="store_true", help="pages and images through the layout")
    c = sub.add_parser("payload", help="files to one text each, as JSON lines")
    c.add_argument("paths", nargs="+")
    c.add_argument("--out", required=True)
    c.add_argument("--ignore-glob")
    c = sub.add_parser("recipe", help="learn a rule from examples (JSON lines with text, type)")
    c.add_argument("examples")
    c.add_argument("--negatives")
    c.add_argument("--name", default="learnt")
    c = sub.add_parser("replay", help="send recorded prompts to a driver")
    c.add_argument("dataset")
    c.add_argument("--driver", default="echo")
    c.add_argument("--out", required=True)
    c.add_argument("--limit", type=int)
    sub.add_parser("drivers", help="list drivers and what is known of them")
    c = sub.add_parser("tenants", help="list tenants, or check one")
    c.add_argument("folder")
    c.add_argument("--tenant")
    c.add_argument("--quiet", action="store_true")
    c = sub.add_parser("run", help="send one prompt to a tenant's or a named driver")
    c.add_argument("--driver")
    c.add_argument("--folder", help="folder of tenant files")
    c.add_argument("--tenant")
    c.add_argument("--recipe", default="default")
    c.add_argument("--prompt")
    c.add_argument("--prompt-file")
    c.add_argument("--metadata", help="a JSON object")
    c.add_argument("--stream", action="store_true", help="print events as they come")
    c = sub.add_parser("profile", help="show a profile, or choose one")
    c.add_argument("name", help="a name, or auto")
    c.add_argument("--folder", action="append", default=[])
    c.add_argument("--state", help="file of recorded outcomes")
    c.add_argument("--deadline-ms", type=int)
    c = sub.add_parser("metrics", help="metrics of a table of call events and one of kernel events (JSON lines)")
    c.add_argument("calls")
    c.add_argument("--kernels")
    c.add_argument("--format", choices=("prometheus", "json", "sentry"), default="prometheus")
    c.add_argument("--label", action="append", default=[], help="key=value")
    c = sub.add_parser("tune", help="best setting of each kernel from trials (JSON lines: kernel, setting, units, seconds)")
    c.add_argument("trials")
    c.add_argument("--out", help="file to keep the choice in")
    a = p.parse_args(argv)
    if a.command in LOCAL:
        return LOCAL[a.command](a)
    return SPARK[a.command](SparkSession.builder.appName("blockloom").getOrCreate(), a)


def _drivers(a: argparse.Namespace) -> int:
    for name in drivers.available():
        print(name, json.dumps(drivers.metadata(name), sort_keys=True))
    return 0


def _tenants(a: argparse.Namespace) -> int:
    tenants = drivers.Tenants(a.folder)
    if a.tenant:
        own = tenants.load(a.tenant)
        print(a.tenant, own["driver"], *sorted(own.get("settings") or {}))
        return 0
    names = tenants.names()
    if names:
        print("\n".join(names))
    return int(not names and not a.quiet)


def _run(a: argparse.Namespace) -> int:
    prompt = a.prompt if a.prompt is not None else Path(a.prompt_file).read_text() if a.prompt_file else sys.stdin.read()
    if not prompt.strip():
        print("no prompt", file=sys.stderr)
        return 2
    meta = json.loads(a.metadata) if a.metadata else None
    try:
        llm = {**recipes.load_recipe(a.recipe).llm, **({"driver": a.driver} if a.driver else {})}
        driver = drivers.Tenants(a.folder).driver(llm, a.tenant) if a.folder else drivers.create(llm.get("driver") or "echo", llm.get("settings"))
        for event in driver.stream(prompt, meta) if a.stream else [driver.generate(prompt, meta)]:
            print(json.dumps(event, ensure_ascii=False))
    except drivers.DriverError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def _convert(spark: SparkSession, a: argparse.Namespace) -> int:
    paths = list(dict.fromkeys([*a.paths, *(files.load_path_entries(a.paths_file) if a.paths_file else [])]))
    blocks, meta = convert(spark, paths, a.recipe, a.profile, drivers.create(a.driver) if a.driver and not a.no_llm else None, a.state, a.visual, ignore=a.ignore_glob)
    sinks.write_jsonl(sinks.documents(blocks, meta.drop("block_count")), a.out)
    return 0


def _payload(spark: SparkSession, a: argparse.Namespace) -> int:
    good, bad = sinks.split_errors(payloads.payloads(files.scan(spark, a.paths, ignore=a.ignore_glob)))
    sinks.write_jsonl(good, a.out)
    for line in bad.select("path", "error").toJSON().toLocalIterator():
        print(line, file=sys.stderr)
    return 0


def _recipe(spark: SparkSession, a: argparse.Namespace) -> int:
    schema = "text string, type string, attrs map<string,string>"
    negatives = spark.read.schema("text string").json(a.negatives) if a.negatives else None
    rule, report = recipes.suggest(spark.read.schema(schema).json(a.examples), negatives)
    print(recipes.render_yaml(a.name, rule, report.first().score), end="")
    return 0


def _replay(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = files.read_records(spark, a.dataset)
    good = rows.where("error is null").drop("error")
    good = good.orderBy("pos").limit(a.limit) if a.limit is not None else good
    done = escalation.call(good, drivers.create(a.driver))
    done.withColumn("driver", F.lit(a.driver)).write.mode("overwrite").json(a.out)
    kept = spark.read.schema("pos bigint, error string").json(a.out)
    log = kept.select("pos", F.lit(True).alias("attempted"), "error").unionByName(rows.where("error is not null").select("pos", F.lit(False).alias("attempted"), "error"))
    summary = control.replay_summary(log).first()
    print(f"processed {summary.processed}, attempted {summary.attempted}, errors {summary.errors}")
    return int(summary.errors > 0)


def _profile(spark: SparkSession, a: argparse.Namespace) -> int:
    folders = tuple(a.folder)
    found = config.auto_profile(spark, a.state, deadline_ms=a.deadline_ms, folders=folders) if a.name == "auto" else config.load_profile(a.name, folders)
    print(json.dumps(dataclasses.asdict(found)))
    return 0


CALLS = "driver string, ts double, ok boolean, latency_ms double, request_bytes bigint, response_bytes bigint, error string"
KERNELS = "kernel string, ms double, units bigint, ok boolean"


def _metrics(spark: SparkSession, a: argparse.Namespace) -> int:
    calls = control.call_metrics(spark.read.schema(CALLS).json(a.calls))
    kernels = control.kernel_stats(spark.read.schema(KERNELS).json(a.kernels) if a.kernels else spark.createDataFrame([], KERNELS))
    labels = config.parse_labels(a.label)
    if a.format == "prometheus":
        print(sinks.exposition(calls, kernels, labels), end="")
        return 0
    event = sinks.metrics_event(calls, kernels, labels)
    if a.format == "json":
        print(json.dumps(event["extra"]["telemetry"]))
        return 0
    try:
        sinks.push_event(event)
    except RuntimeError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def _tune(spark: SparkSession, a: argparse.Namespace) -> int:
    trials = spark.read.schema("kernel string, setting string, units double, seconds double").json(a.trials)
    best = {r.kernel: r.setting for r in control.best_setting(trials).orderBy("kernel").collect()}  # a row for each kernel
    if a.out:
        Path(a.out).write_text(json.dumps(best))
    print(json.dumps(best))
    return 0


LOCAL = {"drivers": _drivers, "tenants": _tenants, "run": _run}
SPARK = {"convert": _convert, "payload": _payload, "recipe": _recipe, "replay": _replay, "profile": _profile, "metrics": _metrics, "tune": _tune}


if __name__ == "__main__":
    sys.exit(main())
