"""The circuit breaker over all tasks equals a walk through each key's calls."""

from collections import defaultdict

import numpy as np
import pytest

from blockloom.operators import breaker

CALLS = "key string, ts double, id long, ok boolean, n int, first double, part int"


def walked(rows, **rule):
    by = defaultdict(list)
    for key, ts, i, ok, *_ in rows:
        if ts is not None:
            by[key].append((ts, i, bool(ok)))
    out = []
    for key, calls in by.items():
        calls.sort()
        states = breaker.walk(breaker.CLOSED, [c[0] for c in calls], [c[2] for c in calls], **rule)
        out += [(key, i, s[2] is not None) for (_, i, _), s in zip(calls, states)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,segment,share,rule", [(0, 7, 0.5, (3, 10.0, 30.0)), (1, 50, 0.97, (2, 5.0, 2.0)), (2, 16384, 0.8, (1, 1.0, 4.0)), (3, 11, 1.0, (4, 6.0, 9.0))])
def test_breaker_equals_the_walk(spark, monkeypatch, seed, segment, share, rule):
    monkeypatch.setattr(breaker, "SEGMENT", segment)
    r = np.random.default_rng(seed)
    rule = dict(zip(("failures", "window", "recovery"), rule))
    keys = ["hot"] * 900 + ["a"] * 200 + ["b"] * 3 + [None] * 60
    rows = [(k, float(r.integers(0, 3000) / 2) + 200 * float(r.integers(0, 4)), i, None if r.random() < 0.02 else bool(r.random() > share), 1, 2.0, 3) for i, k in enumerate(keys)]
    rows += [("late", None, 5000, True, 1, 2.0, 3)]
    df = spark.createDataFrame(rows, CALLS).repartition(5)
    got = sorted(map(tuple, breaker.breaker(df, **rule).collect()), key=repr)
    assert got == walked(rows, **rule)
    assert breaker.breaker(df.limit(0), **rule).count() == 0


def test_constant_maps(monkeypatch):
    """A segment with a reset leaves one state, whatever it began with; the summary is that state."""
    r = np.random.default_rng(4)
    for _ in range(300):
        rule = {"failures": int(r.integers(1, 5)), "window": float(r.integers(1, 12)), "recovery": float(r.integers(1, 12))}
        times, oks = np.sort(r.integers(100, 160, 12)).astype(float), r.random(12) < 0.1
        left = breaker.summary(times, oks, **rule)
        began = [breaker.CLOSED, (99.0, 3, 99.0), (95.0, 1, 90.0), (98.0, 2, None)]
        ends = {breaker.walk(s, times, oks, **rule)[-1] for s in began}
        if left is not None:
            assert ends == {left}
        else:
            assert not oks.any()
