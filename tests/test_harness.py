"""The frozen harness: the guard, the embargoes, what counts as sure."""

from __future__ import annotations

import random

import numpy as np
import pytest
from tidemill.plans import harness as ha

ROWS = "at long, x double, y int"


def test_frozen_rows_are_told_from_others(spark, tmp_path):
    rows = [("a", 1, 5), ("a", 1, 5), ("b", 2, None), (None, 3, 7)]
    make = lambda r: spark.createDataFrame(r, "s string, t long, v int")
    path = f"file://{tmp_path}/rows"
    ha.frozen(make(rows), path, "s", "t", "v")
    assert ha.frozen(make(rows[::-1]).repartition(5), path, "s", "t", "v").count() == 4
    for other in (rows[:3], [*rows, rows[0]], [("a", 1, 6), *rows[1:]], []):
        with pytest.raises(ValueError):
            ha.frozen(make(other), path, "s", "t", "v")
    assert ha.fingerprint(make([]), "s", "t") == "0:0:0"


def test_parts_keep_the_embargo(spark):
    """Training ends five before a window, calibration starts five behind what is fitted; a short past is left out."""
    rows = spark.createDataFrame([(t, 0.5, t % 2) for t in range(100)], ROWS)
    pins = spark.createDataFrame([(0, 10, 20), (1, 90, 95), (2, 200, 300)], "win int, start long, stop long")
    fit, calibration, judged = ({(r["win"], r["at"]) for r in part.collect()} for part in ha.windows(rows, pins, 5, 50))
    cut = round(np.quantile(np.arange(85), 0.9))
    assert {t for w, t in fit if w == 1} == set(range(cut))
    assert {t for w, t in calibration if w == 1} == set(range(cut + 5, 85))
    assert judged == {(1, t) for t in range(90, 95)}
    assert {w for w, _ in fit | calibration} == {1, 2}


def _brute(rows, start, stop, embargo):
    """One window by numpy: line, pooled means, quantiles."""
    past = [r for r in rows if r[0] < start - embargo]
    cut = round(np.quantile([r[0] for r in past], 1 - ha.CALIBRATION))
    b, a = np.polyfit([r[1] for r in past if r[0] < cut], [r[2] for r in past if r[0] < cut], 1)
    raw = lambda r: round(min(1.0, max(0.0, a + b * r[1])), 4)
    cal = sorted((raw(r), r[2]) for r in past if r[0] >= cut + embargo)
    xs = sorted({p for p, _ in cal})
    blocks = [[sum(y for p, y in cal if p == x), sum(p == x for p, _ in cal), 1] for x in xs]
    i = 0
    while i + 1 < len(blocks):
        if blocks[i][0] * blocks[i + 1][1] >= blocks[i + 1][0] * blocks[i][1]:
            blocks[i : i + 2] = [[u + v for u, v in zip(blocks[i], blocks[i + 1], strict=True)]]
            i = max(0, i - 1)
        else:
            i += 1
    ys = [s / n for s, n, k in blocks for _ in range(k)]
    at = lambda p: float(np.interp(p, xs, ys))
    score = lambda p: round(abs(at(p) - 0.5) + ha.TIES * abs(p - 0.5), 12)
    limits = [round(float(np.quantile([score(p) for p, _ in cal], 1 - c)), 12) for c in ha.COVERAGES]
    judged = [(score(raw(r)), (at(raw(r)) > 0.5) == (r[2] == 1)) for r in rows if start <= r[0] < stop]
    return [(len(judged), sum(s >= m for s, _ in judged), sum(ok for s, ok in judged if s >= m)) for m in limits]


def test_judged_as_by_numpy(spark):
    rng = random.Random(5)
    rows = []
    for t in range(3000):
        x = round(rng.random(), 3)
        rows.append((t, x, int(rng.random() < 0.2 + 0.6 * x)))
    pins = [(0, 1500, 2000), (1, 2000, 3000)]
    out = ha.judge(spark.createDataFrame(rows, ROWS), spark.createDataFrame(pins, "win int, start long, stop long"), ha.line_model("x"), 20, 100)
    each = ha.by_window(out)
    got = {(r["win"], r["coverage"]): (r["n_test"], r["n"], r["won"]) for r in each.collect()}
    for w, start, stop in pins:
        for c, expected in zip(ha.COVERAGES, _brute(rows, start, stop, 20), strict=True):
            assert got[w, c] == expected
    p = {r["coverage"]: r for r in ha.pooled(each).collect()}
    assert p[0.1]["hit"] > 0.6
    assert p[0.1]["low_deflated"] < p[0.1]["low"] < p[0.1]["hit"]


def test_nothing_to_judge(spark):
    none = spark.createDataFrame([], ROWS)
    pins = spark.createDataFrame([(0, 10, 20)], "win int, start long, stop long")
    assert ha.by_window(ha.judge(none, pins, ha.line_model("x"), 5, 1)).count() == 0
    unknown = spark.createDataFrame([(t, None, t % 2) for t in range(40)], ROWS)
    assert ha.judge(unknown, pins, ha.line_model("x"), 1, 1).count() == 0
