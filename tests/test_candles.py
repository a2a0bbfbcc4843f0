"""Stored candles: what a correction, a withdrawn trade, a hole and a refresh that was cut short change, and what they leave alone."""

from __future__ import annotations

import pytest

from tidemill.sinks import candles as cd
from tidemill.sources import market as mk

TICK = "symbol string, ts_ms long, trade_id long, price double, lots long"
START = 20_000 * cd.DAY


def _ticks(spark, rows):
    return spark.createDataFrame([(s, START + int(h * mk.HOUR), i, float(p), 50) for i, (s, h, p) in rows.items()], TICK)


def _rows(table, what="close"):
    return {(r.symbol, (r.open_time - START) // mk.HOUR): (r[what], r["pass"]) for r in table.read().collect()}


@pytest.fixture
def store(spark, tmp_path):
    return cd.Candles(spark, f"file://{tmp_path}/c")


def test_only_what_changed_is_written(spark, store):
    symbols = spark.createDataFrame([("a",), ("b",)], "symbol string")
    trades = {i: ("a" if i % 2 else "b", i * 1.5, 10 + i) for i in range(64)}  # 96 hours
    now = START + 97 * mk.HOUR
    first = {i: r for i, r in trades.items() if i != 7}  # a hole in the history
    store.refresh(_ticks(spark, first), symbols, START, now, 1)
    later = {**trades, 3: ("a", 4.5, 99), 50: ("b", 75.0, 77)}  # history stays as it is, the fresh stretch doesn't
    del later[61]  # the only trade of its hour
    changes = store.refresh(_ticks(spark, later), symbols, START, now, 2)
    key = lambda i: (trades[i][0], int(trades[i][1]))
    assert {((r.symbol, (r.open_time - START) // mk.HOUR), r.gone) for r in changes.collect()} == {(key(7), False), (key(50), False), (key(61), True)}
    expected = {key(i): (10.0 + i, 1) for i in trades if i != 61} | {key(7): (17.0, 2), key(50): (77.0, 2)}
    assert _rows(store.fine) == expected
    bars = _rows(store.derived)
    touched = {(s, h // 4 * 4) for s, h in map(key, (7, 50, 61))}
    assert {k for k, (_, p) in bars.items() if p == 2} == touched & bars.keys()
    for (s, h), (close, _) in bars.items():
        assert close == max((k, v[0]) for k, v in expected.items() if k[0] == s and h <= k[1] < h + 4)[1]
    assert store.refresh(_ticks(spark, later), symbols, START, now, 3).count() == 0
    assert _rows(store.fine) == expected


def test_cut_short_is_done_again(spark, store, monkeypatch):
    symbols = spark.createDataFrame([("a",)], "symbol string")
    now = START + 10 * mk.HOUR
    store.refresh(_ticks(spark, {i: ("a", i, i + 1) for i in range(9)}), symbols, START, now, 1)
    fixed = _ticks(spark, {i: ("a", i, 2 * i + 1) for i in range(9)})
    with monkeypatch.context() as m:
        m.setattr(store.fine, "replace_rows", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.refresh(fixed, symbols, START, now, 2)
    store.refresh(fixed, symbols, START, now, 2)
    assert _rows(store.fine) == {("a", i): (2.0 * i + 1, 1 if i == 0 else 2) for i in range(9)}
    assert _rows(store.derived) == {("a", 0): (7.0, 2), ("a", 4): (15.0, 2), ("a", 8): (17.0, 2)}


def test_forming_and_empty(spark, store):
    none = spark.createDataFrame([], "symbol string")
    assert store.refresh(_ticks(spark, {0: ("a", 0, 1)}), none, START, START + 5 * mk.HOUR, 1).count() == 0
    one = spark.createDataFrame([("a",)], "symbol string")
    assert store.refresh(_ticks(spark, {0: ("a", 0, 1)}), one, START, START + mk.HOUR - 1, 2).count() == 0  # still forming
    assert store.fine.read().count() == 0
