"""The live path: bars of closed buckets, late rows, and idempotent predictions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.sinks.tables import Table


def ticks(events: DataFrame) -> DataFrame:
    return events.filter("value > 0").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("trade_id"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("long").alias("lots"), (F.pmod("user_id", F.lit(2)) == 0).alias("is_buyer_maker"),
    )


def tumbling_bars(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None, close_time: bool = False) -> DataFrame:
    """Bars of buckets that the watermark has closed; later rows are dropped. With ``close_time`` they carry it on as their event time."""
    t = ticks(events).withWatermark("at", late)
    at = F.struct("at", "trade_id")
    g = t.groupBy("symbol", F.window("at", width, slide) if slide else F.window("at", width)).agg(F.count("*").alias("trades"), F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("lots").alias("lots"))
    when = [F.window_time("window").alias("closed_at")] if close_time else []
    return g.select("symbol", F.unix_millis("window.start").alias("open_time"), "trades", "open", "high", "low", "close", "lots", *when)


def visits(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user that a gap ends."""
    t = events.select("user_id", F.col("ts").cast("timestamp").alias("at")).withWatermark("at", late)
    g = t.groupBy("user_id", F.session_window("at", gap)).agg(F.count("*").alias("n"))
    return g.select("user_id", F.unix_millis("session_window.start").alias("start"), F.unix_millis("session_window.end").alias("stop"), "n")


def once(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key while its state lives: an insert that ignores repeats."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


_HOUR_US = 3_600_000_000
_WAITING = np.dtype([("us", np.int64), ("id", np.int64), ("up", np.int8)])
_SEEN = np.dtype([("us", np.int64), ("id", np.int64), ("price", np.float64)])


def _packed(df: pd.DataFrame, kind: np.dtype) -> np.ndarray:
    out = np.empty(len(df), kind)
    for name in kind.names:
        out[name] = df[name].to_numpy()
    return out


def _settle(waiting: np.ndarray, seen: np.ndarray) -> pd.DataFrame:
    """For each prediction that has any of the trades in its hour the first of them and how many there are; trades are sorted by (us, id)."""
    first = np.searchsorted(seen["us"], waiting["us"])
    n = np.searchsorted(seen["us"], waiting["us"] + _HOUR_US) - first
    waiting, first, n = (x[n > 0] for x in (waiting, first, n))
    at = seen[first]
    return pd.DataFrame({"prediction_id": waiting["id"], "up": waiting["up"], "out_us": at["us"], "trade_id": at["id"], "price": at["price"], "n": n})


def _resolve(key, frames, state):
    """One clock hour of a symbol: new predictions meet all its trades, those that wait the new ones. It goes when the watermark has passed the hour."""
    if state.hasTimedOut:
        state.remove()
        return
    new = pd.concat(list(frames))
    trade = new["trade"].to_numpy(bool)
    p, o = _packed(new[~trade], _WAITING), _packed(new[trade], _SEEN)
    old_p, old_o = (np.frombuffer(b, t) for b, t in zip(state.get, (_WAITING, _SEEN), strict=True)) if state.exists else (p[:0], o[:0])
    both = np.concatenate([old_o, o])
    o, both = (x[np.lexsort((x["id"], x["us"]))] for x in (o, both))
    state.update((np.concatenate([old_p, p]).tobytes(), both.tobytes()))
    state.setTimeoutTimestamp((int(key[1]) + 1) * 3_600_000)
    for waiting, seen in ((p, both), (old_p, o)):
        out = _settle(waiting, seen)
        if len(out):
            out.insert(0, "symbol", key[0])
            yield out


def resolved(predictions: DataFrame, outcomes: DataFrame, late: str = "1 hour") -> DataFrame:
    """Predictions (symbol, prediction_id, target_at, up) settled by the trades (symbol, out_at, trade_id, price) at the target or within the hour behind it.

    The hour meets two clock hours, so each prediction waits in both and a trade
    goes only into its own. A clock hour of a symbol keeps its rows packed and
    its trades in order, so a prediction finds its first trade and their number
    by two searches, and no pairs are made. Out comes, for each of its hours and
    each micro-batch that brings a prediction trades, one row of those alone:
    ``settled`` puts them together. Rows without symbol, id or time meet nothing.
    """
    hour = F.floor(F.unix_timestamp("at") / 3600)
    p = predictions.select("symbol", F.col("target_at").alias("at"), F.col("prediction_id").alias("id"), F.coalesce(F.col("up").cast("int"), F.lit(-1)).alias("up"), F.lit(None).cast("double").alias("price"), F.lit(False).alias("trade"))
    o = outcomes.select("symbol", F.col("out_at").alias("at"), F.col("trade_id").alias("id"), F.lit(0).alias("up"), "price", F.lit(True).alias("trade"))
    p = p.withWatermark("at", late).withColumn("hour", F.explode(F.array(hour, hour + 1)))
    o = o.withWatermark("at", late).withColumn("hour", hour)
    rows = p.union(o).withColumn("us", F.unix_micros("at")).dropna(subset=["symbol", "at", "id"])
    out, kept = "symbol string, prediction_id long, up int, out_us long, trade_id long, price double, n long", "waiting binary, seen binary"
    return rows.groupBy("symbol", "hour").applyInPandasWithState(_resolve, out, kept, "append", "EventTimeTimeout")


def settled(parts: DataFrame) -> DataFrame:
    """What a drained ``resolved`` says of each prediction: the price of its first trade, and how many trades there are."""
    up = F.when(F.col("up") >= 0, F.col("up") == 1).alias("up")
    price = F.coalesce("price", F.lit(float("nan")))  # pandas has no null besides NaN, and a trade has a price
    return parts.groupBy("symbol", "prediction_id", up).agg(F.min_by(price, F.struct("out_us", "trade_id")).alias("settled_price"), F.sum("n").alias("trades_seen"))


def keep_latest(events: DataFrame, table: Table, checkpoint: str) -> None:
    """Run a stream of trades to its end into a table of one row a symbol: a frame of the same time or later replaces what is there, an older one is ignored.

    Each micro-batch is reduced to a row a symbol before it meets the table, and
    writing it twice changes nothing.
    """

    def merge(batch: DataFrame, _: int) -> None:
        new = batch.groupBy("symbol").agg(F.max(F.struct("at", "trade_id", "price")).alias("t"))
        rows = new.select("symbol", F.unix_millis("t.at").alias("last_at"), F.col("t.trade_id").alias("trade_id"), F.col("t.price").alias("price"))
        both = table.read().unionByName(rows)
        top = both.groupBy("symbol").agg(F.max(F.struct("last_at", "trade_id", "price")).alias("t")).select("symbol", "t.*")
        table.replace_range(F.lit(True), top)

    query = ticks(events).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
