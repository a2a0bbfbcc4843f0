"""Sums without end on fine bars and high levels, and order statistics of long frames, against plain computations."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tidemill.operators import order
from tidemill.operators import rolling as ro

MINUTE = 60_000


def frame(spark, values, step: int = MINUTE):
    return spark.createDataFrame(pd.DataFrame({"symbol": "a", "open_time": np.arange(len(values)) * step, "close": np.asarray(values, float)}))


def test_minute_bars_do_not_overflow(spark):
    """Thousands of bars within a block of hours: no null, no NaN, the recursion's values."""
    x = np.random.default_rng(1).normal(100, 5, 3840)
    out = ro.ewm(frame(spark, x), "close", 0.3).toPandas().sort_values("open_time")
    e = [x[0]]
    for v in x[1:]:
        e.append(0.3 * v + 0.7 * e[-1])
    assert np.allclose(out["ewm_rec"], e, rtol=1e-12)
    assert np.allclose(out["ewm_adj"], pd.Series(x).ewm(alpha=0.3).mean(), rtol=1e-12)


def test_deviation_at_a_high_level(spark):
    """A thousandth up and down at a million."""
    x = 1e6 + 0.001 * (np.arange(600) % 2)
    out = ro.ewm_std(frame(spark, x), "close", 0.2).toPandas().sort_values("open_time")["ewm_std"]
    want = pd.Series(x - 1e6).ewm(alpha=0.2).std()
    assert np.allclose(out[1:], want[1:], rtol=1e-6) and np.isnan(out.iloc[0])
    assert out.iloc[-1] == pytest.approx(0.0005, rel=0.1)


@pytest.mark.parametrize("n", [1, 7, 50, 400])
def test_order_statistics(spark, n, monkeypatch):
    """Frames that reach over several blocks and spans, with ties and holes, against a frame at a time."""
    monkeypatch.setattr(order, "BLOCK", 60)
    monkeypatch.setattr(order, "SPAN", 16)
    x = np.round(np.random.default_rng(3).normal(0, 2, 700))
    x[[0, 50, 51, 52, 300]] = np.nan
    df = frame(spark, x).replace(float("nan"), None)
    out = order.order_statistics(df, "close", n, MINUTE, {"low": 0.25, "med": 0.5}).toPandas().sort_values("open_time").reset_index(drop=True)
    assert len(out) == len(x)
    for i in range(len(x)):
        a = x[max(0, i - n + 1) : i + 1]
        a = a[~np.isnan(a)]
        want = np.nan if np.isnan(x[i]) else ((a < x[i]).sum() + ((a == x[i]).sum() + 1) / 2) / len(a)
        assert out["prank"][i] == pytest.approx(want, nan_ok=True)
        for name, q in (("low", 0.25), ("med", 0.5)):
            assert out[name][i] == pytest.approx(np.quantile(a, q) if len(a) else np.nan, nan_ok=True)


def test_long_frames_are_not_compared_row_by_row():
    """Frames of 26,000 rows over 60,000: some seconds, where n comparisons a row would be over a thousand million."""
    x = np.random.default_rng(4).normal(size=60_000)
    ranks, (med,) = order.trailing(x, 0, 26_000)
    a = x[-26_000:]
    assert ranks[-1] == pytest.approx(((a < x[-1]).sum() + 1) / 26_000) and med[-1] == pytest.approx(np.median(a))
