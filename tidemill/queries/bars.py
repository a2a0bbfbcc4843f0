"""Tick aggregation, resampling and grid repair."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.catalog import query
from tidemill.sources import market as mk

_H = mk.HOUR


def _ticks(spark, sf_dir):
    return mk.trades(spark, sf_dir)


def _candles(spark, sf_dir):
    return mk.candles(_ticks(spark, sf_dir))


@query("bar_candles", f"{mk.with_sql(mk.candles_sql())} SELECT symbol, open_time, open, high, low, close, volume, trades FROM candles")
def bar_candles(spark, sf_dir):
    return _candles(spark, sf_dir)


_AGG = "symbol, open_time, trade_count, buy_volume, sell_volume, buy_trade_count, large_buy_volume, large_sell_volume"


@query("bar_tick_agg", f"{mk.with_sql(mk.bars_sql())} SELECT {_AGG} FROM bars")
def bar_tick_agg(spark, sf_dir):
    return mk.bars(_ticks(spark, sf_dir)).selectExpr(*_AGG.split(", "))


_EL = "symbol, open_time, late_buy_volume, late_sell_volume, early_buy_volume, early_sell_volume, late_trade_count"


@query("bar_early_late", f"{mk.with_sql(mk.bars_sql())} SELECT {_EL} FROM bars")
def bar_early_late(spark, sf_dir):
    return mk.bars(_ticks(spark, sf_dir)).selectExpr(*_EL.split(", "))


@query("bar_closed", f"{mk.with_sql(mk.bars_sql())}, n AS (SELECT max(ts_ms) AS now FROM trades) SELECT symbol, open_time, trade_count FROM bars, n WHERE open_time <= now - now % {_H} - {_H}")
def bar_closed(spark, sf_dir):
    """Only buckets that are over at the time of the last trade."""
    t = _ticks(spark, sf_dir)
    now = t.agg(mk.last_closed(F.max("ts_ms"), _H).alias("last"))
    return mk.bars(t).join(F.broadcast(now), F.col("open_time") <= F.col("last")).select("symbol", "open_time", "trade_count")  # one row


@query(
    "bar_tick_features",
    f"""{mk.with_sql()}, f AS (SELECT *, ts_ms // {_H} * {_H} AS open_time, CASE WHEN is_buyer_maker THEN -qty ELSE qty END AS sq, price * qty AS notional FROM trades)
SELECT symbol, open_time, count(*) AS tick_n, sum(lots) / 50.0 AS tick_vol, round(sum(sq), 6) + 0.0 AS tick_ofi, round(abs(sum(sq)), 6) + 0.0 AS abs_ofi,
  round(sum(CASE WHEN NOT is_buyer_maker THEN qty ELSE 0 END) / sum(qty), 6) + 0.0 AS buy_frac, round(sum(lots) / 50.0 / count(*), 6) + 0.0 AS avg_size,
  round(sum(CASE WHEN notional > 100 THEN sq ELSE 0 END), 6) + 0.0 AS whale_ofi, round(sum(CASE WHEN notional > 100 THEN qty ELSE 0 END) / sum(qty), 6) + 0.0 AS whale_vol_frac,
  round(sum(CASE WHEN ts_ms % {_H} >= {_H} * 2 / 3 THEN sq ELSE 0 END), 6) + 0.0 AS end_ofi, round(stddev_samp(ln(price)), 6) + 0.0 AS tick_rv
FROM f GROUP BY symbol, open_time HAVING sum(lots) > 0""",
)
def bar_tick_features(spark, sf_dir):
    """Flow features of a bucket; whales trade more than 100 in value, the end is the last third."""
    t = _ticks(spark, sf_dir).withColumns({"sq": F.when(F.col("is_buyer_maker"), -F.col("qty")).otherwise(F.col("qty")), "whale": F.col("price") * F.col("qty") > 100, "open_time": mk.bucket(F.col("ts_ms"), _H)})
    total = lambda c, v: F.sum(F.when(c, F.col(v)).otherwise(0.0))
    out = t.groupBy("symbol", "open_time").agg(
        F.count("*").alias("tick_n"), (F.sum("lots") / mk.LOTS).alias("tick_vol"), F.sum("sq").alias("tick_ofi"), F.abs(F.sum("sq")).alias("abs_ofi"), (total(~F.col("is_buyer_maker"), "qty") / F.nullif(F.sum("qty"), F.lit(0.0))).alias("buy_frac"),
        (F.sum("lots") / mk.LOTS / F.count("*")).alias("avg_size"), total(F.col("whale"), "sq").alias("whale_ofi"), (total(F.col("whale"), "qty") / F.nullif(F.sum("qty"), F.lit(0.0))).alias("whale_vol_frac"),
        total(F.col("ts_ms") - F.col("open_time") >= _H * 2 / 3, "sq").alias("end_ofi"), F.stddev_samp(F.ln("price")).alias("tick_rv"),
    )
    return mk.rounded(out.filter("tick_vol > 0"))


@query("bar_resample", f"{mk.with_sql(mk.candles_sql(interval=4 * _H))} SELECT symbol, open_time, open, high, low, close, volume, trades FROM candles")
def bar_resample(spark, sf_dir):
    """Four-hour candles from hourly ones; the oracle builds them from trades."""
    return mk.rounded(mk.resample(_candles(spark, sf_dir), 4 * _H), 9)


@query(
    "bar_gap_detect",
    f"""{mk.with_sql(mk.candles_sql())}, g AS (SELECT symbol, open_time, lead(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS next FROM candles)
SELECT symbol, open_time + {_H} AS gap_start, next - {_H} AS gap_end, CAST((next - open_time) // {_H} - 1 AS BIGINT) AS missing FROM g WHERE next - open_time > {_H}""",
)
def bar_gap_detect(spark, sf_dir):
    after = F.lead("open_time").over(mk.series())
    g = _candles(spark, sf_dir).withColumn("next", after).filter(F.col("next") - F.col("open_time") > _H)
    return g.select("symbol", (F.col("open_time") + _H).alias("gap_start"), (F.col("next") - _H).alias("gap_end"), F.expr(f"(next - open_time) div {_H} - 1").alias("missing"))


@query("bar_dedup", f"{mk.with_sql(mk.candles_sql())} SELECT symbol, open_time, close FROM candles")
def bar_dedup(spark, sf_dir):
    """Overlapping pages of one range: each candle once."""
    c = _candles(spark, sf_dir)
    return c.unionByName(c).dropDuplicates(["symbol", "open_time"]).select("symbol", "open_time", "close")


@query(
    "bar_pages",
    f"""{mk.with_sql(mk.candles_sql())}, r AS (SELECT symbol, min(open_time) AS lo, max(open_time) AS hi FROM candles GROUP BY symbol)
SELECT symbol, unnest(range(lo, hi + 1, 100 * {_H})) AS page_start, least(unnest(range(lo, hi + 1, 100 * {_H})) + 99 * {_H}, hi) AS page_end FROM r""",
)
def bar_pages(spark, sf_dir):
    """The requests of at most 100 candles that cover each symbol's range."""
    r = _candles(spark, sf_dir).groupBy("symbol").agg(F.min("open_time").alias("lo"), F.max("open_time").alias("hi"))
    return r.select("symbol", "hi", F.explode(F.sequence("lo", "hi", F.lit(100 * _H))).alias("page_start")).select("symbol", "page_start", F.least(F.col("page_start") + 99 * _H, "hi").alias("page_end"))


@query(
    "bar_reindex",
    f"""{mk.with_sql(mk.candles_sql())}, r AS (SELECT symbol, unnest(range(min(open_time), max(open_time) + 1, {_H})) AS open_time FROM candles GROUP BY symbol)
SELECT r.symbol, r.open_time, close, close IS NULL AS missing FROM r LEFT JOIN candles c ON r.symbol = c.symbol AND r.open_time = c.open_time""",
)
def bar_reindex(spark, sf_dir):
    """Candles on the whole grid, NULL where there was no trade."""
    c = _candles(spark, sf_dir)
    grid = c.groupBy("symbol").agg(F.explode(F.sequence(F.min("open_time"), F.max("open_time"), F.lit(_H))).alias("open_time"))
    return grid.join(c, ["symbol", "open_time"], "left").select("symbol", "open_time", "close", F.col("close").isNull().alias("missing"))


@query(
    "bar_contiguity",
    f"""{mk.with_sql(mk.candles_sql())}, g AS (SELECT symbol, open_time - lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS step FROM candles)
SELECT symbol, count(*) AS rows, count(*) FILTER (WHERE step <> {_H}) AS breaks, bool_and(coalesce(step, {_H}) = {_H}) AS contiguous FROM g GROUP BY symbol""",
)
def bar_contiguity(spark, sf_dir):
    g = _candles(spark, sf_dir).withColumn("step", F.col("open_time") - F.lag("open_time").over(mk.series()))
    return g.groupBy("symbol").agg(F.count("*").alias("rows"), F.count_if(F.col("step") != _H).alias("breaks"), F.bool_and(F.coalesce("step", F.lit(_H)) == _H).alias("contiguous"))


_SUB = 15 * mk.MINUTE


@query(
    "bar_subbar",
    f"""{mk.with_sql(mk.candles_sql(interval=_SUB), mk.bars_sql(interval=_SUB))}, s AS (SELECT c.symbol, c.open_time, c.open_time // {_H} * {_H} AS bar, ln(close / open) AS r, (buy_volume - sell_volume) / nullif(buy_volume + sell_volume, 0) AS ti
  FROM candles c JOIN bars b ON c.symbol = b.symbol AND c.open_time = b.open_time)
SELECT symbol, bar AS open_time, round(avg(ti), 6) + 0.0 AS ti_mean, round(arg_max(ti, open_time), 6) + 0.0 AS ti_last, round(max(abs(r)), 6) + 0.0 AS max_move, count(*) FILTER (WHERE sign(r) = sign(ti)) AS sign_agree, round(arg_max(r, open_time), 6) + 0.0 AS last_r
FROM s GROUP BY symbol, bar""",
)
def bar_subbar(spark, sf_dir):
    """Quarter-hour flow and moves summarised by hour; the last taker imbalance is the last known one."""
    t = _ticks(spark, sf_dir)
    volume = F.col("buy_volume") + F.col("sell_volume")
    s = mk.candles(t, _SUB).join(mk.bars(t, _SUB), ["symbol", "open_time"]).withColumns({"r": F.ln(F.col("close") / F.col("open")), "ti": F.when(volume != 0, (F.col("buy_volume") - F.col("sell_volume")) / volume)})
    out = s.groupBy("symbol", mk.bucket(F.col("open_time"), _H).alias("bar")).agg(
        F.avg("ti").alias("ti_mean"), F.max_by("ti", F.when(F.col("ti").isNotNull(), F.col("open_time"))).alias("ti_last"), F.max(F.abs("r")).alias("max_move"),
        F.count_if(F.signum("r") == F.signum("ti")).alias("sign_agree"), F.max_by("r", "open_time").alias("last_r"),
    )
    return mk.rounded(out.withColumnRenamed("bar", "open_time"))


@query(
    "bar_metrics_left_join",
    f"""{mk.with_sql(mk.bars_sql())}, m AS (SELECT epoch_ms(o_orderdate) AS ts, arg_max(o_totalprice, o_orderkey) AS open_interest FROM orders WHERE o_totalprice > 0 GROUP BY 1)
SELECT symbol, open_time, trade_count, open_interest FROM bars LEFT JOIN m ON (open_time // 86400000 - 19723 + 9000) * 86400000 = m.ts""",
)
def bar_metrics_left_join(spark, sf_dir):
    """Bars with a metric by exact time (orders of an earlier day stand in); of equal times the last row wins."""
    m = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_totalprice > 0").groupBy(F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts")).agg(F.max_by("o_totalprice", "o_orderkey").alias("open_interest"))
    day = F.expr("(open_time div 86400000 - 19723 + 9000) * 86400000")
    b = mk.bars(_ticks(spark, sf_dir)).withColumn("ts", day)
    return b.join(m, "ts", "left").select("symbol", "open_time", "trade_count", "open_interest")


@query(
    "bar_intrabar",
    f"""{mk.with_sql(mk.candles_sql(interval=_SUB))}, s AS (SELECT *, open_time // {_H} * {_H} AS bar, row_number() OVER (PARTITION BY symbol, open_time // {_H} ORDER BY open_time) AS step FROM candles),
b AS (SELECT symbol, bar, arg_max(close, open_time) AS bar_close FROM s GROUP BY ALL)
SELECT s.symbol, s.bar AS open_time, step, s.close, bar_close > s.close AS up FROM s JOIN b ON s.symbol = b.symbol AND s.bar = b.bar WHERE step <= 3""",
)
def bar_intrabar(spark, sf_dir):
    """Within an hour, at each of its first three quarters: does the rest of it rise?"""
    whole = Window.partitionBy("symbol", "bar").orderBy("open_time")
    s = mk.candles(_ticks(spark, sf_dir), _SUB).withColumn("bar", mk.bucket(F.col("open_time"), _H))
    s = s.withColumns({"step": F.row_number().over(whole), "bar_close": F.last("close").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    return s.filter("step <= 3").select("symbol", F.col("bar").alias("open_time"), F.col("step").cast("long").alias("step"), "close", (F.col("bar_close") > F.col("close")).alias("up"))
