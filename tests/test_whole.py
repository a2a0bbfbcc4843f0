"""Queries do the whole job: small fixtures against brute force."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from tidemill import catalog

QUERIES = catalog.queries()
EVENTS = "event_id long, user_id long, event_type string, ts timestamp_ntz, value double, props string"


@pytest.fixture
def ticks(spark, tmp_path):
    """A few hours of events of two symbols, some without a value, in one file; the folder and the rows."""
    rng = random.Random(3)
    at = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(150):
        at += dt.timedelta(seconds=rng.randrange(0, 240))
        rows.append((i, rng.randrange(9), rng.choice(["buy", "sell"]), at, rng.choice([0.0, *(float(x) for x in range(40, 60))]), f'{{"k": {rng.randrange(100)}}}'))
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path), [r for r in rows if r[4] > 0]


def test_resolve_settles_every_trade(spark, ticks):
    """Each trade whose second hour has a trade comes out once, with the first of them."""
    home, rows = ticks
    hour, expected = dt.timedelta(hours=1), []
    for i, _, symbol, at, _, props in rows:
        seen = sorted((t, j, price) for j, _, s, t, price, _ in rows if s == symbol and at + hour <= t < at + 2 * hour)
        if seen:
            expected.append((i, seen[0][2], symbol, len(seen), int(props[6:-1]) > 50))
    got = QUERIES["stream_resolve"](spark, home).select("prediction_id", "settled_price", "symbol", "trades_seen", "up").collect()
    assert sorted(map(tuple, got)) == sorted(expected)
