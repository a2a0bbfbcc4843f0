"""Decisions, quotes and bets over the event table: what the later operators read.

A decision is taken at an anchor candle for the candle two on. Its
probability comes from fixed logistic weights, 0.5 (no bet) in warm-up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import indicators as ind
from tidemill.sources import market as mk

HORIZON = 2
#: Fixed weights of the stand-in model, and the fixed price of either side.
WEIGHTS = {"bias": 0.05, "z20": -0.35, "ret_3": 2.0}
PRICE = 0.55


def decisions(spark, sf_dir: str, interval: int = mk.HOUR) -> DataFrame:
    """symbol, anchor_open, target_open, p_up, outcome_up (strict: a doji is down), target_open_price, target_close."""
    w = mk.series()
    c = mk.candles(mk.trades(spark, sf_dir), interval)
    z, r = ind.zscore(F.col("close"), w), ind.log_return(F.col("close"), w, 3)
    c = c.withColumns({"z20": z, "ret_3": r, "t": F.lead(F.struct("open_time", "open", "close"), HORIZON).over(w)}).filter("t IS NOT NULL")
    score = WEIGHTS["bias"] + WEIGHTS["z20"] * F.col("z20") + WEIGHTS["ret_3"] * F.col("ret_3")
    p = F.round(F.coalesce(1 / (1 + F.exp(-score)), F.lit(0.5)), 5)
    return c.select("symbol", F.col("open_time").alias("anchor_open"), F.col("t.open_time").alias("target_open"), p.alias("p_up"), (F.col("t.close") > F.col("t.open")).alias("outcome_up"), F.col("t.open").alias("target_open_price"), F.col("t.close").alias("target_close"), "close")


def bets(spark, sf_dir: str) -> DataFrame:
    """Decisions with a side: p_up of exactly 0.5 abstains."""
    d = decisions(spark, sf_dir).filter("p_up <> 0.5")
    return d.withColumn("won", (F.col("p_up") >= 0.5) == F.col("outcome_up"))


def quotes(spark, sf_dir: str) -> DataFrame:
    """Stand-in venue prices from orders: key, observed_at, order, price."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderpriority").alias("key"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("observed_at"), F.col("o_orderkey").alias("quote_id"), (0.02 + 0.96 * (F.col("o_orderkey") % 97) / 97).alias("price"))


def side(p: Column) -> Column:
    return F.when(p >= 0.5, "UP").otherwise("DOWN")


DECISIONS_SQL = f"""{mk.candles_sql()},
dz AS (SELECT *, CASE WHEN count(*) OVER w20 = 20 THEN CASE WHEN stddev_pop(close) OVER w20 = 0 THEN 0.0 ELSE (close - avg(close) OVER w20) / stddev_pop(close) OVER w20 END END AS z20,
  CASE WHEN lag(close, 3) OVER w > 0 THEN ln(close / lag(close, 3) OVER w) END AS ret_3,
  lead(open_time, 2) OVER w AS t_open_time, lead(open, 2) OVER w AS t_open, lead(close, 2) OVER w AS t_close
  FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY open_time), w20 AS (PARTITION BY symbol ORDER BY open_time ROWS 19 PRECEDING)),
decisions AS (SELECT symbol, open_time AS anchor_open, t_open_time AS target_open, round(coalesce(1 / (1 + exp(-(0.05 - 0.35 * z20 + 2.0 * ret_3))), 0.5), 5) AS p_up, t_close > t_open AS outcome_up, t_open AS target_open_price, t_close AS target_close, close
  FROM dz WHERE t_open_time IS NOT NULL),
bets AS (SELECT *, (p_up >= 0.5) = outcome_up AS won FROM decisions WHERE p_up <> 0.5)"""
QUOTES_SQL = "quotes AS (SELECT o_orderpriority AS key, epoch_ms(o_orderdate) AS observed_at, o_orderkey AS quote_id, 0.02::DOUBLE + 0.96::DOUBLE * (o_orderkey % 97) / 97 AS price FROM orders)"


def with_sql(*more: str) -> str:
    return mk.with_sql(DECISIONS_SQL, *more)
