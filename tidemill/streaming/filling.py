"""Live bars without holes: a stateful step behind the tumbling aggregation, with event-time timers.

Bars reach the step when the watermark closes them. It keeps one row a symbol
(the last bucket and its close); a bucket without trades is made up as a flat
bar as soon as the watermark has passed its end, whether or not a later bar
ever comes. After a long silence only the last MOST_BACK buckets are filled.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidemill.streaming import live

#: Buckets filled behind a bar or the watermark, at most: two days of five minutes (fixed value).
MOST_BACK = 576

_BAR = "symbol string, open_time long, trades long, open double, high double, low double, close double, lots long, filled boolean"


class Fill(StatefulProcessor):
    def __init__(self, width: int):
        self.width = width

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "open_time long, close double")

    def _flat(self, symbol: str, start: int, stop: int, close: float) -> Iterator[Row]:
        """Flat bars of the buckets of [start, stop), the last MOST_BACK of them."""
        for at in range(max(start, stop - MOST_BACK * self.width), stop, self.width):
            yield Row(symbol=symbol, open_time=at, trades=0, open=close, high=close, low=close, close=close, lots=0, filled=True)

    def _wait(self, at: int) -> None:
        """Remember the time at which the bucket behind ``at`` must have closed, in place of any other."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at + 2 * self.width)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        symbol, known = key[0], self.last.get()
        for bar in sorted(rows, key=lambda r: r.open_time):
            if known and bar.open_time <= known[0]:
                continue  # its bucket has been made up or seen
            if known:
                yield from self._flat(symbol, known[0] + self.width, bar.open_time, known[1])
            yield Row(**{c: bar[c] for c in ("symbol", "open_time", "trades", "open", "high", "low", "close", "lots")}, filled=False)
            known = (bar.open_time, bar.close)
        if known:
            self.last.update(tuple(known))
            self._wait(known[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        symbol, (at, close) = key[0], self.last.get()
        stop = timerValues.getCurrentWatermarkInMs() // self.width * self.width  # the start of the first open bucket
        if stop > at + self.width:
            yield from self._flat(symbol, at + self.width, stop, close)
            at = stop - self.width
            self.last.update((at, close))
        self._wait(at)

    def close(self) -> None:
        pass


def filled_bars(events: DataFrame, width: int, late: str = "10 minutes") -> DataFrame:
    """Bars of ``width`` ms of a stream of events, each bucket from a symbol's first on exactly once, with ``filled`` for those without trades."""
    bars = live.tumbling_bars(events, f"{width} milliseconds", late, close_time=True)
    steps = bars.groupBy("symbol").transformWithState(statefulProcessor=Fill(width), outputStructType=_BAR, outputMode="Append", timeMode="EventTime")
    return steps.select(*(c.split()[0] for c in _BAR.split(", ")))


@contextmanager
def timers(spark: SparkSession):
    """Timers need a state store of columns, which is set for the streams started in here."""
    key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, store)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def oracle_sql(trades: str, candles: str, width: int, late: int) -> str:
    """The same from the whole table: all buckets whose end the last watermark has passed, closes carried on."""
    return f"""
WITH {trades}, {candles}, m AS (SELECT (max(ts_ms) - {late}) // {width} * {width} AS stop FROM trades),
b AS (SELECT c.*, lead(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS following FROM candles c, m WHERE open_time < stop),
f AS (SELECT symbol, unnest(range(greatest(open_time + {width}, coalesce(following, stop) - {MOST_BACK * width}), coalesce(following, stop), {width})) AS open_time, close FROM b, m)
SELECT symbol, open_time, trades, open, high, low, close, CAST(round(volume * 50) AS BIGINT) AS lots, false AS filled FROM b
UNION ALL SELECT symbol, open_time, 0, close, close, close, close, 0, true FROM f"""
