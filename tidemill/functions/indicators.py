"""Indicators as Column expressions; every one is NULL until it has enough rows.

The simple ones are window aggregates. Those with memory (EMA, RSI, MACD)
start afresh in each bounded slice of the series, so they fold the collected
slice with higher-order functions and never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Candles that a decision sees.
LIMIT = 60


def trailing(w, n: int):
    return w.rowsBetween(-(n - 1), 0)


def _full(c: Column, w, n: int, value: Column) -> Column:
    return F.when(F.count(c).over(trailing(w, n)) == n, value)


def sma(c: Column, w, n: int) -> Column:
    return _full(c, w, n, F.avg(c).over(trailing(w, n)))


def zscore(c: Column, w, n: int = 20) -> Column:
    """Population z-score of the last row among n; 0 where they don't vary."""
    std = F.stddev_pop(c).over(trailing(w, n))
    return _full(c, w, n, F.when(std == 0, F.lit(0.0)).otherwise((c - F.avg(c).over(trailing(w, n))) / std))


def bollinger(c: Column, w, n: int = 20, k: float = 2.0) -> tuple[Column, Column]:
    mid, std = F.avg(c).over(trailing(w, n)), F.stddev_pop(c).over(trailing(w, n))
    return _full(c, w, n, mid + k * std), _full(c, w, n, mid - k * std)


def log_return(c: Column, w, lag: int) -> Column:
    before = F.lag(c, lag).over(w)
    return F.when(before > 0, F.ln(c / before))


def true_range(w) -> Column:
    before = F.lag("close").over(w)
    return F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def slice_of(c: str, w, limit: int = LIMIT) -> Column:
    """The last ``limit`` values as an array, oldest first."""
    return F.collect_list(c).over(trailing(w, limit))


def ema(values: Column, n: int) -> Column:
    """EMA over an array, seeded with the mean of its first n values."""
    k = 2 / (n + 1)
    seed = F.aggregate(F.slice(values, 1, n), F.lit(0.0), lambda a, x: a + x) / n
    rest = F.slice(values, F.lit(n + 1), F.greatest(F.size(values) - n, F.lit(0)))
    return F.when(F.size(values) >= n, F.aggregate(rest, seed, lambda a, x: x * k + a * (1 - k)))


def deltas(values: Column) -> Column:
    n = F.greatest(F.size(values) - 1, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(2), n), F.slice(values, F.lit(1), n), lambda b, a: b - a)


def rsi(values: Column, n: int = 14) -> Column:
    """Wilder's RSI over an array; 100 without losses."""
    d = deltas(values)
    rest = F.slice(d, F.lit(n + 1), F.greatest(F.size(d) - n, F.lit(0)))

    def smooth(pick) -> Column:
        seed = F.aggregate(F.slice(d, 1, n), F.lit(0.0), lambda a, x: a + pick(x)) / n
        return F.aggregate(rest, seed, lambda a, x: (a * (n - 1) + pick(x)) / n)

    gain = smooth(lambda x: F.greatest(x, F.lit(0.0)))
    loss = smooth(lambda x: F.greatest(-x, F.lit(0.0)))
    return F.when(F.size(values) > n, F.when(loss == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + gain / loss)))


def macd(values: Column, fast: int = 12, slow: int = 26, signal: int = 9) -> Column:
    """struct(macd, signal, hist) over an array; one pass advances both EMAs and the signal line."""
    kf, ks, kg = 2 / (fast + 1), 2 / (slow + 1), 2 / (signal + 1)
    head = F.slice(values, 1, slow)
    f0, s0 = ema(head, fast), ema(head, slow)
    start = F.struct(f0.alias("f"), s0.alias("s"), F.lit(1).alias("n"), (f0 - s0).alias("g"))

    def step(a: Column, x: Column) -> Column:
        f, s = x * kf + a["f"] * (1 - kf), x * ks + a["s"] * (1 - ks)
        m, n = f - s, a["n"] + 1
        g = F.when(n < signal, a["g"] + m).when(n == signal, (a["g"] + m) / signal).otherwise(m * kg + a["g"] * (1 - kg))
        return F.struct(f.alias("f"), s.alias("s"), n.alias("n"), g.alias("g"))

    rest = F.slice(values, F.lit(slow + 1), F.greatest(F.size(values) - slow, F.lit(0)))
    end = F.aggregate(rest, start, step)
    done = F.struct((end["f"] - end["s"]).alias("macd"), end["g"].alias("signal"), (end["f"] - end["s"] - end["g"]).alias("hist"))
    return F.when(F.size(values) >= slow + signal - 1, done)


# The same in DuckDB SQL, over list expressions.


def ema_sql(values: str, n: int) -> str:
    k = 2 / (n + 1)
    return f"(CASE WHEN len({values}) >= {n} THEN list_reduce(list_slice({values}, {n + 1}, len({values})), lambda a, x: x * {k!r}::DOUBLE + a * {1 - k!r}::DOUBLE, list_sum(list_slice({values}, 1, {n})) / {n}) END)"


def rsi_sql(values: str, n: int = 14) -> str:
    d = f"list_transform(range(2, len({values}) + 1), lambda i: {values}[i] - {values}[i - 1])"

    def smooth(pick: str) -> str:
        g = f"list_transform({d}, lambda x: {pick})"
        return f"list_reduce(list_slice({g}, {n + 1}, len({values})), lambda a, x: (a * {n - 1} + x) / {n}, list_sum(list_slice({g}, 1, {n})) / {n})"

    gain, loss = smooth("greatest(x, 0.0::DOUBLE)"), smooth("greatest(-x, 0.0::DOUBLE)")
    return f"(CASE WHEN len({values}) > {n} THEN CASE WHEN {loss} = 0 THEN 100.0 ELSE 100 - 100 / (1 + {gain} / {loss}) END END)"


def macd_series_sql(values: str) -> str:
    part = f"list_slice({values}, 1, i)"
    return f"list_transform(range(26, len({values}) + 1), lambda i: {ema_sql(part, 12)} - {ema_sql(part, 26)})"
