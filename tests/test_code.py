"""A user's function as a node: ports, missing values, seeds, and batches that equal steps."""

from __future__ import annotations

import json

import pytest

from tidemill.plans import code as cn

BARS = "symbol string, open_time long, a double, b double"
PORTS = {"inputs": {"a": "series", "b": "scalar"}, "outputs": {"x": "scalar", "y": "series", "name": "label", "draw": "scalar"}}


def _node(inputs, params, rng):
    out = {"x": sum(v for v in inputs["a"] if v is not None) * params.get("by", 1) / 3, "y": inputs["a"], "draw": rng.random()}
    if "b" in inputs:
        out["name"] = f"b{inputs['b']:.0f}"
    return out


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(s, t, float(t * t % 7) if t % 5 else None, float(t) if t % 3 else None) for s in "pqr" for t in range(40)]
    return spark.createDataFrame(rows, BARS).repartition(5)


def _sorted(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_batch_equals_steps(bars):
    whole = cn.batch(bars, _node, PORTS, {"by": 2}, seed=3, lookback=6)
    assert whole.columns == ["symbol", "open_time", "x", "y", "name", "draw"]
    assert whole.schema["y"].dataType.simpleString() == "array<double>"
    one = cn.step(cn.history(bars, PORTS, 6), _node, PORTS, {"by": 2}, seed=3)
    rows = _sorted(whole)
    assert rows == _sorted(one)
    assert rows == _sorted(cn.batch(bars.repartition(2), _node, PORTS, {"by": 2}, seed=3, lookback=6))
    assert [r[:5] for r in rows] == [r[:5] for r in _sorted(cn.batch(bars, _node, PORTS, {"by": 2}, seed=4, lookback=6))]
    assert {r[5] for r in rows}.isdisjoint(r[5] for r in _sorted(cn.batch(bars, _node, PORTS, {"by": 2}, seed=4, lookback=6)))
    for s, t, x, y, name, _ in rows:
        seen = [float(k * k % 7) if k % 5 else None for k in range(max(0, t - 5), t + 1)]
        assert y == seen and x == round(sum(v or 0 for v in seen) * 2 / 3, 9) and name == (f"b{t}" if t % 3 else None)


def test_values_are_rounded_and_finite(bars):
    ports = {"inputs": {}, "outputs": {"up": "scalar", "down": "scalar", "nan": "scalar", "none": "scalar", "big": "scalar"}}
    out = lambda i, p, r: {"up": 0.0000000005, "down": -2.5e-9, "nan": float("nan"), "big": 1e300}
    assert {tuple(r)[2:] for r in cn.batch(bars, out, ports).collect()} == {(1e-9, -3e-9, None, None, 1e300)}


def test_sql_and_errors(spark, bars):
    cn.register(spark, "node_under_test", lambda i, p, r: {"x": i.get("b", -1.0)})
    ask = lambda ports: spark.sql(f"SELECT * FROM node_under_test(TABLE({{bars}}), :ports, '{{{{}}}}', 0L)", args={"ports": json.dumps(ports)}, bars=bars)
    assert sorted({r.x for r in ask({"inputs": {"b": "scalar"}, "outputs": {"x": "scalar"}}).collect()})[0] == -1.0
    for wrong in ({"inputs": {"zzz": "scalar"}, "outputs": {"x": "scalar"}}, {"inputs": {}, "outputs": {}}, {"outputs": {"x": "candle"}}):
        with pytest.raises(Exception, match="no column|needs an output|no known tag"):
            ask(wrong).collect()
    empty = bars.filter("symbol = 'zz'")
    assert cn.batch(empty, _node, PORTS).count() == 0
