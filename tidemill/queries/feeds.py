"""Feeds written as text and read back, and messages decoded in place. The texts are made from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog import query
from tidemill.sources import archives as ar
from tidemill.sources import feeds as fd
from tidemill.sources import market as mk
from tidemill.streaming.run import folder

_H = mk.HOUR


def _text(*columns):
    """A CSV line; NULL is an empty field."""
    return F.concat_ws(",", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))


@query("feed_trades_csv", f"{mk.with_sql()} SELECT trade_id, price, qty, ts_ms, is_buyer_maker FROM trades")
def feed_trades_csv(spark, sf_dir):
    """Dump files of trades: each with a header and a broken row, every third trade in µs."""
    t = mk.trades(spark, sf_dir)
    time = F.when(F.col("trade_id") % 3 == 0, F.col("ts_ms") * 1000 + 7).otherwise(F.col("ts_ms"))
    line = _text(F.col("trade_id"), F.col("price"), F.col("qty"), F.col("trade_id"), F.col("trade_id"), time, F.col("is_buyer_maker"), F.lit(True))
    broken = t.select("symbol").distinct().select(F.explode(F.array(F.lit("agg_trade_id,price,quantity,first,last,transact_time,is_buyer_maker,best"), F.lit("17,not a price,1.0,1,1,1700000000000,true,true"), F.lit("18,1.5"))).alias("value"))
    at = folder(spark, "trades-csv")
    t.select(line.alias("value")).union(broken).write.text(at)
    return fd.trades_csv(spark, at)


def _zipped(key, lines):
    """One archive of a symbol and day: its trades, a member that is no CSV, and one that is broken."""
    import io
    import zipfile

    import pandas as pd

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("trades.csv", "\n".join(["agg_trade_id,price", *lines["value"]]))
        z.writestr("read.me", "9,1.0,1.0,9,9,1700000000000,true,true")
        z.writestr("broken.csv", "8,1.0,1.0,8,8,1700000000000,true,true\n" * 50)
    content = bytearray(out.getvalue())
    at = content.rindex(b"broken.csv", 0, content.index(b"PK\x01\x02")) + len("broken.csv")
    content[at : at + 8] = b"\xff" * 8
    return pd.DataFrame({"path": [f"{key[0]}-{key[1]}.zip"], "content": [bytes(content)]})


@query("feed_trades_zip", f"{mk.with_sql()}, d AS (SELECT *, ts_ms // {24 * _H} AS day, min(ts_ms // {24 * _H}) OVER () AS first FROM trades) SELECT trade_id, price, qty, ts_ms, is_buyer_maker FROM d WHERE day > first")
def feed_trades_zip(spark, sf_dir):
    """Archives of CSV, one a symbol and day, with a broken member each; the first day is held already and left out."""
    t = mk.trades(spark, sf_dir)
    line = _text(F.col("trade_id"), F.col("price"), F.col("qty"), F.col("trade_id"), F.col("trade_id"), F.col("ts_ms"), F.col("is_buyer_maker"), F.lit(True))
    day = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd").alias("day")
    at = folder(spark, "trades-zip")
    t.select("symbol", day, line.alias("value")).groupBy("symbol", "day").applyInPandas(_zipped, "path string, content binary").write.parquet(at)
    archives = spark.read.schema("path string, content binary").parquet(at).withColumn("day", ar.day_of(F.col("path")))
    held = archives.agg(F.min("day").alias("day"))
    return ar.trades(archives.join(held, "day", "left_anti"))


@query(
    "feed_metrics_csv",
    f"""{mk.with_sql(mk.candles_sql())} SELECT symbol, open_time AS ts_ms, volume AS open_interest, CASE WHEN open_time // {_H} % 5 <> 0 THEN close END AS open_interest_value, low AS top_ratio FROM candles""",
)
def feed_metrics_csv(spark, sf_dir):
    """Metrics with empty fields, an unreadable time, and a row of greater values before every row, which does not count."""
    c = mk.candles(mk.trades(spark, sf_dir))
    time = F.date_format(F.timestamp_millis("open_time"), "yyyy-MM-dd HH:mm:ss")
    value = F.when(F.floor(F.col("open_time") / _H) % 5 != 0, F.col("close"))
    line = lambda more: _text(time, F.col("symbol"), F.col("volume") + more, value + more, F.lit("n/a"), F.col("low") + more, F.lit(None), F.lit(None))
    rows = c.select(F.explode(F.array(line(7), line(0))).alias("value"))
    head = spark.createDataFrame([("create_time,symbol,sum_open_interest",)], "value string")
    at = folder(spark, "metrics-csv")
    rows.union(head).write.text(at)
    return fd.metrics_csv(spark, at).select("symbol", "ts_ms", "open_interest", "open_interest_value", "top_ratio")


def _days(c):
    """Candles of each symbol and day as a sorted list of structs."""
    return c.groupBy("symbol", mk.bucket(F.col("open_time"), 24 * _H).alias("day")).agg(F.array_sort(F.collect_list(F.struct("open_time", "open", "high", "low", "close", "volume"))).alias("rows"))


@query("feed_klines_json", f"{mk.with_sql(mk.candles_sql())} SELECT symbol, open_time, open, high, low, close, volume FROM candles")
def feed_klines_json(spark, sf_dir):
    """Candles as arrays of arrays, a message for each symbol and day."""
    names = ("open", "high", "low", "close", "volume")
    message = F.to_json(F.transform("rows", lambda x: F.array(x["open_time"].cast("string"), *(x[n].cast("string") for n in names), F.lit("0"))))
    m = _days(mk.candles(mk.trades(spark, sf_dir))).select("symbol", message.alias("payload"))
    return m.select("symbol", F.explode(fd.klines(F.col("payload"))).alias("k")).select("symbol", "k.*")


@query("feed_price_points", f"{mk.with_sql(mk.candles_sql())} SELECT symbol, open_time AS t, close AS p FROM candles WHERE open_time // {_H} % 4 <> 0")
def feed_price_points(spark, sf_dir):
    """A price series with rows that lack a time or a price."""
    hour = lambda x: F.floor(x["open_time"] / _H) % 4
    message = F.to_json(F.struct(F.transform("rows", lambda x: F.struct(F.when(hour(x) != 0, x["open_time"]).alias("t"), F.when((hour(x) != 0) | (x["close"] < 0), x["close"]).alias("p"))).alias("history")), {"ignoreNullFields": "false"})
    m = _days(mk.candles(mk.trades(spark, sf_dir))).select("symbol", message.alias("payload"))
    return m.select("symbol", F.explode(fd.points(F.col("payload"))).alias("k")).select("symbol", "k.*")


_SIDE = "list_sum([coalesce({0}, 0.0), coalesce({1}, 0.0)])"


@query(
    "feed_order_book",
    f"""{mk.with_sql(mk.candles_sql())}, b AS (SELECT symbol, open_time, low * volume + open * 2 AS bid, CASE WHEN volume > 0 THEN high * volume + close * 3 ELSE 0.0 END AS ask, low AS bb, CASE WHEN volume > 0 THEN high ELSE 0.0 END AS ba FROM candles)
SELECT symbol, open_time, round(bid, 4) + 0.0 AS bid, round(ask, 4) + 0.0 AS ask, round(CASE WHEN bid + ask > 0 THEN (bid - ask) / (bid + ask) ELSE 0.0 END, 4) + 0.0 AS imbalance, bb AS best_bid, ba AS best_ask, round(ba - bb, 4) + 0.0 AS spread FROM b""",
)
def feed_order_book(spark, sf_dir):
    """Imbalance and spread of books of two levels a side; no asks without volume."""
    c = mk.candles(mk.trades(spark, sf_dir))
    level = lambda p, q: F.array(p.cast("string"), q.cast("string"))
    asks = F.when(F.col("volume") > 0, F.array(level(F.col("high"), F.col("volume")), level(F.col("close"), F.lit(3)))).otherwise(F.array().cast("array<array<string>>"))
    payload = F.to_json(F.struct(F.array(level(F.col("low"), F.col("volume")), level(F.col("open"), F.lit(2))).alias("bids"), asks.alias("asks")))
    return mk.rounded(c.select("symbol", "open_time", fd.order_book(payload).alias("b")).select("symbol", "open_time", "b.*"), 4)


@query(
    "feed_trade_flow",
    f"""{mk.with_sql()}, g AS (SELECT symbol, ts_ms // 86400000 * 86400000 AS day, count(*) AS n, sum(CASE WHEN is_buyer_maker THEN 0.0 ELSE price * qty END) AS buy, sum(CASE WHEN is_buyer_maker THEN price * qty ELSE 0.0 END) AS sell FROM trades GROUP BY ALL)
SELECT symbol, day, n, round(buy, 4) + 0.0 AS buy, round(sell, 4) + 0.0 AS sell, round(CASE WHEN buy + sell > 0 THEN buy / (buy + sell) ELSE 0.5 END, 4) + 0.0 AS pressure, round((buy + sell) / n, 4) + 0.0 AS avg_size FROM g""",
)
def feed_trade_flow(spark, sf_dir):
    """Bought and sold by takers, by day."""
    t = mk.trades(spark, sf_dir).withColumn("day", mk.bucket(F.col("ts_ms"), 24 * _H))
    return mk.rounded(fd.trade_flow(t, "symbol", "day"), 4)


@query(
    "feed_interest_delta",
    f"""{mk.with_sql(mk.candles_sql())}, l AS (SELECT symbol, open_time, list(close) OVER (PARTITION BY symbol ORDER BY open_time ROWS 12 PRECEDING) AS b FROM candles)
SELECT symbol, open_time, b[len(b)] AS latest, CASE WHEN len(b) >= 2 AND b[len(b) - 1] <> 0 THEN round((b[len(b)] - b[len(b) - 1]) / b[len(b) - 1] * 100, 3) + 0.0 ELSE 0.0 END AS short, CASE WHEN len(b) >= 13 AND b[1] <> 0 THEN round((b[len(b)] - b[1]) / b[1] * 100, 3) + 0.0 ELSE 0.0 END AS long FROM l""",
)
def feed_interest_delta(spark, sf_dir):
    """Changes of open interest in messages of the last thirteen bins."""
    w = mk.series().rowsBetween(-12, 0)
    c = mk.candles(mk.trades(spark, sf_dir)).withColumn("payload", F.to_json(F.collect_list(F.struct(F.col("close").cast("string").alias("sumOpenInterest"))).over(w)))
    return mk.rounded(c.select("symbol", "open_time", fd.interest_delta(F.col("payload")).alias("d")).select("symbol", "open_time", "d.*"), 3)


@query("feed_premium", f"{mk.with_sql(mk.candles_sql())} SELECT symbol, open_time, close AS mark_price, open_time + 28800000 AS next_funding, CASE WHEN volume > 0 THEN low END AS funding_rate FROM candles")
def feed_premium(spark, sf_dir):
    """Scalars of a message; an unreadable rate is NULL."""
    c = mk.candles(mk.trades(spark, sf_dir))
    payload = F.to_json(F.struct(F.when(F.col("volume") > 0, F.col("low").cast("string")).otherwise("none").alias("lastFundingRate"), F.col("close").cast("string").alias("markPrice"), (F.col("open_time") + 28_800_000).alias("nextFundingTime")))
    return c.select("symbol", "open_time", fd.premium(payload).alias("m")).select("symbol", "open_time", "m.*")
