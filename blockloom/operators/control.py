"""Metrics, profile choice and resilience as aggregates and column arithmetic."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .breaker import breaker as breaker  # the breaker over a log of calls

# fixed values: limits of the profile rules and weights of the reward
LARGE_BYTES, TIGHT_MS, SLOW_KERNEL_MS, MOST_FAILURES = 5_000_000, 1200, 180.0, 0.35
LATENCY_TARGET_MS, LEAST_REWARD, MOST_REWARD = 3600.0, -1.0, 1.5


def call_metrics(events: DataFrame) -> DataFrame:
    """Per driver: calls, successes, failures, total_latency_ms, bytes, avg_latency_ms and last_error.

    events: driver, ts, ok, latency_ms, request_bytes, response_bytes, error. A success clears the error before it.
    """
    amount = lambda c: F.sum(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)))
    out = events.groupBy("driver").agg(
        F.count("*").alias("calls"),
        F.count_if("ok").alias("successes"),
        F.count_if(~F.col("ok")).alias("failures"),
        amount(F.col("latency_ms")).alias("total_latency_ms"),
        amount(F.col("request_bytes")).alias("request_bytes"),
        amount(F.col("response_bytes")).alias("response_bytes"),
        F.max_by(F.struct(F.when(~F.col("ok"), F.col("error")).alias("e")), "ts")["e"].alias("last_error"),
    )
    return out.withColumn("avg_latency_ms", F.try_divide("total_latency_ms", "calls"))


def kernel_stats(events: DataFrame) -> DataFrame:
    """Per kernel: calls, total_ms, units, failures and avg_ms. events: kernel, ms, units, ok."""
    out = events.groupBy("kernel").agg(F.count("*").alias("calls"), F.sum("ms").alias("total_ms"), F.sum("units").alias("units"), F.count_if(~F.col("ok")).alias("failures"))
    return out.withColumn("avg_ms", F.try_divide("total_ms", "calls"))


def rule_choice(size: Column, deadline: Column, kernel_ms: Column, failures: Column) -> Column:
    """Profile by rule: large files, tight deadlines, slow kernels, failing drivers; null where no rule speaks."""
    return F.when(size >= LARGE_BYTES, "archival").when(deadline <= TIGHT_MS, "realtime").when(kernel_ms >= SLOW_KERNEL_MS, "realtime").when(failures >= MOST_FAILURES, "balanced")


def reward(latency_ms: Column, blocks: Column, escalations: Column, truncated: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    speed = F.greatest(F.lit(0.0), 1 - zero(latency_ms) / LATENCY_TARGET_MS)
    share = lambda c: F.when(zero(blocks) > 0, zero(c) / zero(blocks)).otherwise(0.0)
    return F.least(F.greatest(speed * 0.6 + share(escalations) * 0.4 - share(truncated) * 0.25, F.lit(LEAST_REWARD)), F.lit(MOST_REWARD))


def accumulate(outcomes: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """(profile, trials, reward_sum) from outcomes (profile, latency_ms, blocks, escalations, truncated), on top of a state."""
    new = outcomes.groupBy("profile").agg(F.count("*").alias("trials"), F.sum(reward(*map(F.col, ("latency_ms", "blocks", "escalations", "truncated")))).alias("reward_sum"))
    both = new if state is None else new.unionByName(state.select("profile", "trials", "reward_sum"))
    return both.groupBy("profile").agg(F.sum("trials").alias("trials"), F.sum("reward_sum").alias("reward_sum"))


def bandit_choice(state: DataFrame, profiles: list[str], epsilon: float = 0.1, seed: int = 0) -> str:
    """An unexplored profile first; a random one with chance epsilon (seeded by the number of trials); else the best mean."""
    known = {r.profile: r for r in state.where(F.col("profile").isin(profiles)).collect()}  # one row per profile
    fresh = [p for p in profiles if p not in known or not known[p].trials]
    if fresh:
        return fresh[0]
    import random

    rng = random.Random(seed + sum(r.trials for r in known.values()))
    if rng.random() < epsilon:
        return rng.choice(profiles)
    return max(profiles, key=lambda p: known[p].reward_sum / known[p].trials)


def backoff(attempt: Column, base: float, most: float, jitter: float = 0.0, seed: int = 0) -> Column:
    wait = F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(most))
    return wait + F.rand(seed) * jitter if jitter else wait


class Stages:
    """Wall times of a run's stages, on the driver: `with stages("parse"): ...` around what starts a job."""

    def __init__(self) -> None:
        self.ms: dict[str, float] = {}

    @contextmanager
    def __call__(self, name: str) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        finally:
            self.ms[name] = self.ms.get(name, 0.0) + (time.perf_counter() - start) * 1000

    def rows(self) -> list[tuple[str, float]]:
        return [*self.ms.items(), ("total", sum(self.ms.values()))]


def observed(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """rows, and an observation of how many of them pass and how many characters they hold, once a job has run over them."""
    seen = Observation(name)
    chars = F.sum(F.length("text")) if "text" in rows.columns else F.lit(None).cast("bigint")
    return rows.observe(seen, F.count("*").alias("rows"), chars.alias("chars")), seen


def best_setting(trials: DataFrame) -> DataFrame:
    """(kernel, setting): the setting with the largest throughput in trials (kernel, setting, units, seconds)."""
    return trials.groupBy("kernel").agg(F.max_by("setting", F.struct(F.try_divide("units", "seconds"), "setting")).alias("setting"))


def replay_summary(rows: DataFrame, first: int = 5) -> DataFrame:
    """processed, attempted, errors and the first errors of replayed records (pos, attempted, error)."""
    bad = rows.where("error is not null").orderBy("pos").limit(first).agg(F.array_sort(F.collect_list(F.struct("pos", "error"))).alias("s"))
    counts = rows.agg(F.count_if(F.col("attempted") & F.col("error").isNull()).alias("processed"), F.count_if("attempted").alias("attempted"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    return counts.crossJoin(bad).select("processed", "attempted", "errors", F.transform("s", lambda x: x["error"]).alias("first_errors"))  # one row each
