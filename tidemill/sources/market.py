"""Trades, candles and order-flow bars over the event table, in DataFrames and in oracle SQL.

Aggregations group by (symbol, bucket), so trades combine before the shuffle
and a busy symbol spreads over its buckets. Prices and volumes are doubles;
volumes are sums of whole lots divided once, so they don't depend on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MINUTE = 60_000
HOUR = 60 * MINUTE
#: Lots a unit of quantity, and the quantity from which a trade is large.
LOTS, LARGE = 50.0, 1.0
#: Position in the bucket from which a trade is late, and under which it is early.
LATE, EARLY = 0.8, 0.2


def bucket(ts: Column, interval: int) -> Column:
    """Start of the tumbling bucket of a time in ms."""
    return ts - F.pmod(ts, F.lit(interval))


def floored(ts: int, interval: int) -> int:
    """The same of a number."""
    return ts - ts % interval


def last_closed(now: Column, interval: int) -> Column:
    """Start of the latest bucket that is over."""
    return bucket(now, interval) - interval


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts_ms, trade_id, price, lots, qty, is_buyer_maker; trades without a positive price don't count."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("value > 0").withColumn("lots", F.get_json_object("props", "$.k").cast("long"))
    return events.select(
        F.col("event_type").alias("symbol"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.col("event_id").alias("trade_id"),
        F.col("value").alias("price"),
        "lots",
        (F.col("lots") / LOTS).alias("qty"),
        (F.pmod("user_id", F.lit(2)) == 0).alias("is_buyer_maker"),
    )


def candles(ticks: DataFrame, interval: int = HOUR) -> DataFrame:
    """OHLCV by (symbol, open_time); first and last go by (ts_ms, trade_id)."""
    at = F.struct("ts_ms", "trade_id")
    return ticks.groupBy("symbol", bucket(F.col("ts_ms"), interval).alias("open_time")).agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        (F.sum("lots") / LOTS).alias("volume"),
        F.count("*").alias("trades"),
    )


def resample(bars: DataFrame, interval: int) -> DataFrame:
    """Coarser candles from finer ones, labelled and closed on the left."""
    return bars.groupBy("symbol", bucket(F.col("open_time"), interval).alias("bucket")).agg(
        F.min_by("open", "open_time").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "open_time").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("trades").alias("trades"),
    ).withColumnRenamed("bucket", "open_time")


def bars(ticks: DataFrame, interval: int = HOUR) -> DataFrame:
    """Order-flow bars: a trade whose buyer is the maker is a sell."""
    pos = (F.col("ts_ms") - bucket(F.col("ts_ms"), interval)) / interval
    buy, large, late, early = ~F.col("is_buyer_maker"), F.col("qty") >= LARGE, pos >= LATE, pos < EARLY
    vol = lambda c: F.coalesce(F.sum(F.when(c, F.col("lots"))), F.lit(0)) / LOTS
    return ticks.groupBy("symbol", bucket(F.col("ts_ms"), interval).alias("open_time")).agg(
        F.count("*").alias("trade_count"),
        vol(buy).alias("buy_volume"),
        vol(~buy).alias("sell_volume"),
        F.count_if(buy).alias("buy_trade_count"),
        vol(buy & large).alias("large_buy_volume"),
        vol(~buy & large).alias("large_sell_volume"),
        vol(buy & late).alias("late_buy_volume"),
        vol(~buy & late).alias("late_sell_volume"),
        vol(buy & early).alias("early_buy_volume"),
        vol(~buy & early).alias("early_sell_volume"),
        F.count_if(late).alias("late_trade_count"),
    )


def series(*order: str) -> Window:
    """The window of one symbol in time order."""
    return Window.partitionBy("symbol").orderBy(*(order or ("open_time",)))


TRADES_SQL = """trades AS (
  SELECT event_type AS symbol, epoch_us(ts) // 1000 AS ts_ms, event_id AS trade_id, value AS price,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS lots, CAST(json_extract_string(props, '$.k') AS BIGINT) / 50.0 AS qty, user_id % 2 = 0 AS is_buyer_maker
  FROM events WHERE value > 0)"""


def candles_sql(name: str = "candles", interval: int = HOUR) -> str:
    return f"""{name} AS (
  SELECT symbol, ts_ms // {interval} * {interval} AS open_time, arg_min(price, (ts_ms, trade_id)) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, (ts_ms, trade_id)) AS close, sum(lots) / 50.0 AS volume, count(*) AS trades
  FROM trades GROUP BY ALL)"""


def bars_sql(name: str = "bars", interval: int = HOUR) -> str:
    pos = f"((ts_ms % {interval}) / {interval}.0)"
    vol = lambda c, n: f"coalesce(sum(lots) FILTER (WHERE {c}), 0) / 50.0 AS {n}"
    return f"""{name} AS (
  SELECT symbol, ts_ms // {interval} * {interval} AS open_time, count(*) AS trade_count, {vol("NOT is_buyer_maker", "buy_volume")}, {vol("is_buyer_maker", "sell_volume")},
    count(*) FILTER (WHERE NOT is_buyer_maker) AS buy_trade_count, {vol("NOT is_buyer_maker AND qty >= 1", "large_buy_volume")}, {vol("is_buyer_maker AND qty >= 1", "large_sell_volume")},
    {vol(f"NOT is_buyer_maker AND {pos} >= 0.8", "late_buy_volume")}, {vol(f"is_buyer_maker AND {pos} >= 0.8", "late_sell_volume")},
    {vol(f"NOT is_buyer_maker AND {pos} < 0.2", "early_buy_volume")}, {vol(f"is_buyer_maker AND {pos} < 0.2", "early_sell_volume")},
    count(*) FILTER (WHERE {pos} >= 0.8) AS late_trade_count
  FROM trades GROUP BY ALL)"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join([TRADES_SQL, *ctes])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; -0 becomes 0."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))
