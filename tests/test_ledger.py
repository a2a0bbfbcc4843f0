"""The ledger against a dictionary: repeated, late and cut-short deliveries, snapshots, what an account can pay, drift."""

from __future__ import annotations

import os
import random
from decimal import Decimal

import pytest

from tidemill.sinks import ledger as le

ROW = f"account long, kind string, ref long, amount {le.MONEY}"


@pytest.fixture
def ledger(spark, tmp_path):
    return le.Ledger(spark, f"file://{tmp_path}/l")


def _add(ledger, rows):
    return ledger.add(ledger.spark.createDataFrame([(a, k, r, Decimal(x)) for a, k, r, x in rows], ROW))


def _state(ledger, **how):
    return {r.account: (r.cash, r.reserved, r.available) for r in ledger.balances(**how).collect()}


def _brute(deliveries):
    first = {}
    for rows in deliveries:
        least = {}
        for a, k, r, x in rows:
            least[a, r, k] = min(Decimal(x), least.get((a, r, k), Decimal(x)))
        first = {**least, **first}
    out = {}
    for a, r in {key[:2] for key in first}:
        at = lambda k, a=a, r=r: first.get((a, r, k))
        cash, reserved = out.get(a, (Decimal(0), Decimal(0)))
        cash += (at("deposit") or 0) + ((at("settle") - (at("reserve") or 0)) if at("settle") is not None else 0)
        if at("release") is None and at("settle") is None:
            reserved += at("reserve") or 0
        out[a] = cash, reserved
    return {a: (c, r, c - r) for a, (c, r) in out.items()}


def test_snapshots_agree_with_all_entries(ledger):
    rng, deliveries = random.Random(11), []
    for step in range(6):
        rows = [(rng.randrange(3), rng.choice(le.KINDS), rng.choice([None, *range(6)]), rng.randrange(1, 90)) for _ in range(12)]
        if step == 4:
            rows = deliveries[0]
        deliveries.append(rows)
        _add(ledger, rows)
        if step % 2:
            assert ledger.recompute() == ledger.recompute() == step + 1
        assert _state(ledger) == _state(ledger, whole=True) == _brute(deliveries)


@pytest.mark.parametrize("small", [0, 1 << 40], ids=["looked up", "grouped"])
def test_older_entries_looked_up_or_grouped(ledger, small, monkeypatch):
    """Both ways give the balances of all entries; only the first joins."""
    monkeypatch.setattr(le, "SMALL", small)
    rng, deliveries = random.Random(12), []
    for step in range(4):
        deliveries.append([(rng.randrange(3), rng.choice(le.KINDS), rng.choice([None, *range(6)]), rng.randrange(1, 90)) for _ in range(12)])
        _add(ledger, deliveries[-1])
        assert _state(ledger) == _brute(deliveries)
        if step:
            assert ("Join" in ledger._moved(step)._jdf.queryExecution().toString()) == (not small)
        ledger.recompute()


def test_unfinished_writes_count_for_nothing(ledger, tmp_path):
    _add(ledger, [(1, "deposit", None, 10)])
    assert ledger.recompute() == 1
    lost = _add(ledger, [(1, "deposit", 5, 99)])
    os.remove(f"{tmp_path}/l/log/{lost}/_SUCCESS")
    assert _state(ledger)[1][0] == 10
    assert _add(ledger, [(1, "deposit", 5, 1)]) == lost + 1
    assert ledger.recompute() == lost + 1
    os.remove(f"{tmp_path}/l/accounts/{lost + 1}/_SUCCESS")
    assert _state(ledger)[1][0] == 11
    ledger.recompute()
    assert _state(ledger)[1][0] == 11


def test_only_what_can_be_paid_is_reserved(ledger):
    spark = ledger.spark
    ask = lambda *rows: sorted((r.account, r.ref, r.amount) for r in ledger.reserve(spark.createDataFrame([(a, r, None if x is None else Decimal(x)) for a, r, x in rows], f"account long, ref long, amount {le.MONEY}")).collect())
    assert ask((1, 1, "5")) == []  # no account
    _add(ledger, [(1, "deposit", None, 100), (2, "deposit", None, 100)])
    assert ask((1, 1, "100.0001"), (2, 1, "100")) == [(2, 1, 100)]  # a ten thousandth too much; exactly enough
    assert ask((1, 1, "60"), (1, 2, "50"), (1, 3, "40"), (1, 4, None), (1, 5, "0"), (1, 6, "-5")) == [(1, 1, 60)]
    assert ask((1, 1, "60"), (1, 3, "40"), (2, 2, "0.0001")) == [(1, 3, 40)]
    assert _state(ledger) == {1: (100, 100, 0), 2: (100, 100, 0)}


def test_drift_is_told_and_unknown_wallets_have_none(ledger):
    _add(ledger, [(a, "deposit", None, 50) for a in (1, 2, 3, 4)] + [(a, "reserve", 9, 30) for a in (1, 2, 3)])
    wallets = [(1, Decimal("29.9999")), (2, Decimal(30)), (2, Decimal(77)), (3, None), (5, Decimal(1))]
    got = {r.account: r for r in ledger.reconcile(ledger.spark.createDataFrame(wallets, f"account long, wallet {le.MONEY}")).collect()}
    assert [(a, got[a].drift, got[a].alert, got[a].free) for a in sorted(got)] == [
        (1, Decimal("0.0001"), True, Decimal("-0.0001")), (2, 0, False, 0), (3, None, False, -30), (4, None, False, 0), (5, -1, False, 1)
    ]


def test_nothing_there(ledger):
    assert _state(ledger) == _state(ledger, whole=True) == {}
    assert ledger.recompute() == 0
    assert ledger.reconcile(ledger.spark.createDataFrame([], f"account long, wallet {le.MONEY}")).count() == 0
    _add(ledger, [])
    assert ledger.recompute() == 1
    assert _state(ledger) == {}
