"""Streams run to their end; their oracles are the batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog import query
from tidemill.sinks.tables import Table
from tidemill.sources import market as mk
from tidemill.streaming import filling, live
from tidemill.streaming.run import drain, folder, read_events

_H = mk.HOUR
_MAX = "(SELECT max(epoch_us(ts)) // 1000 FROM events WHERE value > 0)"


@query(
    "stream_tumbling_bars",
    f"""{mk.with_sql(mk.candles_sql())} SELECT symbol, open_time, trades, open, high, low, close, CAST(round(volume * 50) AS BIGINT) AS lots FROM candles WHERE open_time + {_H} <= {_MAX} - 600000""",
)
def stream_tumbling_bars(spark, sf_dir):
    """Hourly bars that the watermark has closed."""
    return drain(live.tumbling_bars(read_events(spark, sf_dir)), "bars")


_FIVE = 5 * mk.MINUTE


@query("stream_filled_bars", filling.oracle_sql(mk.TRADES_SQL, mk.candles_sql(interval=_FIVE), _FIVE, 600_000))
def stream_filled_bars(spark, sf_dir):
    """Five-minute bars without holes: timers make up the buckets in which nothing was traded."""
    with filling.timers(spark):
        return drain(filling.filled_bars(read_events(spark, sf_dir), _FIVE), "filled")


@query(
    "stream_sliding_bars",
    f"""{mk.with_sql()}, s AS (SELECT *, unnest([ts_ms // {_H} * {_H}, ts_ms // {_H} * {_H} - {_H}]) AS open_time FROM trades) SELECT symbol, open_time, count(*) AS trades, max(price) AS high, min(price) AS low FROM s GROUP BY ALL HAVING open_time + 2 * {_H} <= {_MAX} - 600000""",
)
def stream_sliding_bars(spark, sf_dir):
    """Two-hour bars every hour."""
    return drain(live.tumbling_bars(read_events(spark, sf_dir), "2 hours", slide="1 hour"), "sliding").select("symbol", "open_time", "trades", "high", "low")


@query("stream_dedup", "SELECT event_id, user_id FROM events")
def stream_dedup(spark, sf_dir):
    """Events that arrive twice are kept once."""
    e = read_events(spark, sf_dir)
    return drain(live.once(e.union(e), ["event_id"]).select("event_id", "user_id"), "dedup")


@query(
    "stream_sessions",
    """WITH o AS (SELECT user_id, epoch_us(ts) // 1000 AS t, epoch_us(ts) AS u, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
k AS (SELECT *, sum(CASE WHEN b IS NULL OR u - b >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY u ROWS UNBOUNDED PRECEDING) AS s FROM o)
SELECT user_id, min(u) // 1000 AS start, (max(u) + 1800000000) // 1000 AS stop, count(*) AS n FROM k GROUP BY user_id, s HAVING (max(u) + 1800000000) // 1000 <= (SELECT max(epoch_us(ts)) // 1000 FROM events) - 3600000""",
)
def stream_sessions(spark, sf_dir):
    """A user's visits, ended by half an hour without events."""
    return drain(live.visits(read_events(spark, sf_dir)), "visits")


@query(
    "stream_resolve",
    f"""{mk.with_sql()}, u AS (SELECT event_id AS trade_id, epoch_us(ts) AS us FROM events WHERE value > 0), t AS (SELECT trades.*, us FROM trades JOIN u USING (trade_id))
SELECT p.symbol, p.trade_id AS prediction_id, p.lots > 50 AS up, arg_min(o.price, (o.us, o.trade_id)) AS settled_price, count(*) AS trades_seen
FROM t p JOIN t o ON p.symbol = o.symbol AND o.us >= p.us + 3600000000 AND o.us < p.us + 7200000000 GROUP BY ALL""",
)
def stream_resolve(spark, sf_dir):
    """Every trade of one stream as a prediction, settled by the trades of another."""
    p = live.ticks(read_events(spark, sf_dir)).select("symbol", F.col("trade_id").alias("prediction_id"), (F.col("at") + F.expr("INTERVAL 1 HOUR")).alias("target_at"), (F.col("lots") > 50).alias("up"))
    o = live.ticks(read_events(spark, sf_dir)).select("symbol", F.col("at").alias("out_at"), "trade_id", "price")
    return live.settled(drain(live.resolved(p, o), "resolve"))


@query("stream_latest_candle", f"{mk.with_sql()} SELECT symbol, max(ts_ms) AS last_at, arg_max(price, (ts_ms, trade_id)) AS price FROM trades GROUP BY symbol")
def stream_latest_candle(spark, sf_dir):
    """The live row of each symbol, kept by a stream in a table."""
    at = folder(spark, "latest")
    table = Table(spark, f"{at}/table", "last_at long, trade_id long, price double, symbol string", "symbol")
    live.keep_latest(read_events(spark, sf_dir), table, f"{at}/state")
    return table.read().select("symbol", "last_at", "price")
