"""Stored candles with coarser ones derived from them, refreshed in part.

Behind the last closed bucket the latest 48 hours are built anew, since trades
may still be corrected there; older buckets are history and only filled where
they are missing. Days without a change are not touched; in the others rows that
came out as they were are carried over, and of the derived bars only those with a
changed candle in them are built anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sinks.tables import Table
from tidemill.sources import market as mk

DAY = 24 * mk.HOUR
#: The stretch that is always built anew (a fixed value).
FRESH = 48 * mk.HOUR
_VALUES = ["open", "high", "low", "close", "volume", "trades"]
_KEYS = ["symbol", "open_time"]
_ROW = "symbol string, open_time long, open double, high double, low double, close double, volume double, trades long, pass long, day long"


class Candles:
    """Candles of ``interval`` and bars of ``coarse`` (a multiple of it that divides a day) under ``path``, a partition a day.

    ``pass`` of a row is the number of the refresh that wrote it. A refresh that was
    cut short is done again under its number: it starts from what the tables hold.
    """

    def __init__(self, spark: SparkSession, path: str, interval: int = mk.HOUR, coarse: int = 4 * mk.HOUR):
        if coarse % interval or DAY % coarse:
            raise ValueError("coarse must be a multiple of interval and divide a day")
        self.spark, self.path, self.interval, self.coarse = spark, path, interval, coarse
        self.fine, self.derived = Table(spark, f"{path}/fine", _ROW, "day"), Table(spark, f"{path}/derived", _ROW, "day")

    def _wanted(self, symbols: DataFrame, start: int, stop: int) -> DataFrame:
        """(symbol, open_time) to build: the fresh stretch, and older buckets that are not held."""
        fresh = max(start, mk.floored(stop - FRESH, self.interval))
        grid = lambda a, b: symbols.select("symbol", F.explode(F.sequence(F.lit(a), F.lit(b), F.lit(self.interval))).alias("open_time"))
        if fresh <= start:
            return grid(start, stop)
        held = self.fine.read().filter(F.col("day").between(mk.floored(start, DAY), fresh)).select(*_KEYS)
        return grid(start, fresh - self.interval).join(held, _KEYS, "left_anti").unionByName(grid(fresh, stop))

    def refresh(self, ticks: DataFrame, symbols: DataFrame, start: int, now: int, number: int) -> DataFrame:
        """Bring the buckets from ``start`` to the last closed one before ``now`` up to date; returns the keys that changed, ``gone`` where no trade is left.

        ``symbols`` are the series to keep, each once. Ticks are summed up before they meet the wanted buckets.
        """
        start, stop = mk.floored(start, self.interval), mk.floored(now, self.interval) - self.interval
        log = f"{self.path}/changes/pass={number}"
        if stop >= start:
            wanted = self.spark.read.parquet(self._write(self._wanted(symbols, start, stop), f"{self.path}/wanted/pass={number}"))
            first, last = wanted.agg(F.min("open_time"), F.max("open_time")).first()
        else:
            first = None
        if first is None:
            return self.spark.createDataFrame([], "symbol string, open_time long, gone boolean")
        within = F.col("open_time").between(first, last)
        built = mk.candles(ticks.filter(F.col("ts_ms").between(first, last + self.interval - 1)), self.interval).join(wanted, _KEYS, "left_semi")
        held = self.fine.read().filter(F.col("day").between(mk.floored(first, DAY), last) & within).join(wanted, _KEYS, "left_semi")
        packed = lambda df, name: df.select(*_KEYS, F.struct(*_VALUES).alias(name))
        both = packed(built, "new").join(packed(held, "old"), _KEYS, "full_outer")
        changed = both.filter(~F.col("new").eqNullSafe(F.col("old"))).select(*_KEYS, "new", F.col("new").isNull().alias("gone"), mk.bucket(F.col("open_time"), DAY).alias("day"))
        changes = self.spark.read.parquet(self._write(changed, log))
        rows = changes.filter("NOT gone").select("symbol", "open_time", "new.*", F.lit(number).cast("long").alias("pass"), "day")
        self.derived.replace_rows(*self._derived(changes, rows, number))
        self.fine.replace_rows(changes.select(*_KEYS, "day"), rows, _KEYS)
        return changes.select(*_KEYS, "gone")

    def _derived(self, changes: DataFrame, rows: DataFrame, number: int) -> tuple:
        """Bars with a changed candle in them: their keys, the rows to come, and the names of the keys.

        They are written before the candles, so that a refresh that was cut short
        finds the same changes again.
        """
        keys = changes.select("symbol", mk.bucket(F.col("open_time"), self.coarse).alias("open_time"), "day").distinct()
        days = [r[0] for r in keys.select("day").distinct().collect()]  # days of this call
        still = self.fine.read().filter(F.col("day").isin(days)).join(changes.select(*_KEYS), _KEYS, "left_anti")
        now = still.select(rows.columns).unionByName(rows)
        bars = mk.resample(now, self.coarse).join(keys, _KEYS, "left_semi")
        return keys, bars.select("symbol", "open_time", *_VALUES, F.lit(number).cast("long").alias("pass"), mk.bucket(F.col("open_time"), DAY).alias("day")), _KEYS

    def _write(self, rows: DataFrame, path: str) -> str:
        rows.write.mode("overwrite").parquet(path)
        return path
