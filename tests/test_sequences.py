"""The sequence model: chance on noise, far above it on a planted signal, nothing from nothing."""

from __future__ import annotations

import random

from tidemill.plans import sequences as sq

BARS = "symbol string, t long, v double"


def test_lags_are_of_the_own_series(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, None), ("a", 4, 4.0), ("a", 5, 5.0), ("b", 6, 6.0)], BARS)
    out, x = sq.lagged(df, "symbol", "t", ["v"], 2)
    assert x == ["v_lag0", "v_lag1"]
    assert sorted(map(tuple, out.select("t", *x).collect())) == [(2, 2.0, 1.0), (5, 5.0, 4.0)]


def test_controls(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(s, t, rng.gauss(0, 1)) for s in "abc" for t in range(1200)], BARS)
    rows, x = sq.lagged(df, "symbol", "t", ["v"], 4)
    rows = sq.controls(rows, ["symbol", "t"], "v_lag0", "v_lag1").coalesce(2).cache()
    turned = rows.filter("planted <> CAST(v_lag0 > v_lag1 AS INT)").count() / rows.count()
    assert 0.07 < turned < 0.13
    noise, planted = (sq.judged(sq.walk(rows, "t", x, y, 2, 5), y) for y in ("noise", "planted"))
    assert noise["n"] == planted["n"] == 3 * 798  # the last two thirds of the 1197 rows that each series has lags for
    assert 0.45 < noise["accuracy"] < 0.55
    assert 0.45 < noise["auc"] < 0.55
    assert planted["accuracy"] > 0.8
    assert planted["auc"] > 0.8
    assert planted["surest"] >= planted["accuracy"]
    rows.unpersist()


def test_no_rows(spark):
    rows, x = sq.lagged(spark.createDataFrame([], BARS), "symbol", "t", ["v"], 2)
    rows = sq.controls(rows, ["symbol", "t"], *x)
    said = sq.walk(rows, "t", x, "noise", 2, 5)
    assert said.count() == 0
    assert sq.judged(said, "noise")["n"] == 0
