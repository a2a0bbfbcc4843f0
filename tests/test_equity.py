"""Runs on credit and their windows against a loop, and imports under each policy."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import equity as eq
from tidemill.sinks import tables as tb


def _loop(rows, bank, price):
    balance = top = low = bank
    borrowed = fall = crossings = 0
    for stake, won in rows:
        short = max(stake - max(balance, 0), 0)
        after = balance + (round(stake * (1 - price) / price, 6) if won else -stake)
        sign = lambda x: (x > 0) - (x < 0)
        crossings += short > 0 or sign(round(balance, 6)) != sign(round(after, 6))
        balance, top, low = after, max(top, after), min(low, after)
        borrowed, fall = max(borrowed, short, -after), max(fall, top - after)
    return [len(rows), balance, top, low, fall, borrowed, crossings]


def test_runs_against_a_loop(spark):
    rng = random.Random(4)
    runs = {k: [(rng.choice([5.0, 10.0, 40.0]), rng.random() < 0.5) for _ in range(rng.randrange(1, 40))] for k in range(12)}
    df = spark.createDataFrame([(k, t, s, w) for k, rows in runs.items() for t, (s, w) in enumerate(rows)], "run long, t long, asked double, won boolean")
    got = eq.stats(eq.equity(df, ["run"], "t", F.col("asked"), 0.55, 30.0), ["run"], "t", 30.0).collect()
    assert len(got) == len(runs)
    for r in got:
        assert list(r)[1:] == pytest.approx(_loop(runs[r.run], 30.0, 0.55), abs=1e-5)


def test_windows_and_empty_combos(spark):
    samples = spark.createDataFrame([("a", 70.0, True, 5.0, 0), ("a", 90.0, True, 8.0, 2), ("b", 80.0, True, 1.0, 0), ("b", 10.0, False, 60.0, 3), ("c", 40.0, True, 30.0, 0)], "combo string, final double, survived boolean, max_drawdown double, crossings long")
    combos = spark.createDataFrame([(x,) for x in "abcd"], "combo string")
    got = {r.combo: r for r in eq.windows(samples, combos, ["combo"], 60.0).collect()}
    assert [got[x].passes for x in "abcd"] == [True, False, False, False]
    assert [got[x].bust_rate for x in "abcd"] == [0, 0.5, 0, 1]
    assert (got["a"].p5, got["a"].p50, got["a"].p95, got["a"].worst_drawdown, got["a"].mean_crossings) == (11, 20, 29, 8, 1)
    assert tuple(got["d"])[1:] == (0, 1.0, 0, 0, 0, 0, 0, 0, False)


def test_import_policies(spark):
    held = spark.createDataFrame([(1, "x", "old"), (2, "y", None), (3, "y (imported)", "z")], "id long, name string, payload string")
    rows = [{"id": 5, "name": "x", "payload": "new"}, {"id": 5, "name": "x", "payload": "new"}, {"id": 6, "name": "y", "payload": None}, {"id": 1, "name": "n", "payload": "p"}]
    bundle = spark.createDataFrame([(json.dumps(r),) for r in rows], "bundle string")
    got = {p: sorted(map(tuple, tb.import_sessions(held, bundle, p).collect())) for p in tb.POLICIES}
    base = [(1, "x", "old"), (2, "y", None), (3, "y (imported)", "z")]
    assert got["skip"] == [*base, (4, "n", "p")]
    assert got["replace"] == [(1, "x", "new"), *base[1:], (4, "n", "p")]
    assert got["rename"] == [*base, (4, "n", "p"), (8, "x (imported)", "new")]
    with pytest.raises(ValueError, match="policy"):
        tb.import_sessions(held, bundle, "merge")
