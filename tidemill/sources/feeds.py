"""Market feeds as text: dumps of trades and metrics in CSV, and candles, books, points and open interest in JSON.

Numbers come as strings. What can't be read is left out (rows) or NULL (values);
nothing here looks at more than one message at a time, so a reader scales with
its files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A time over this is in microseconds (a fixed value).
MICROS_FROM = 100_000_000_000_000


def millis(t: Column) -> Column:
    """A time in ms or µs as ms."""
    return F.when(t > MICROS_FROM, F.floor(t / 1000)).otherwise(t).cast("long")


def trades_csv(spark: SparkSession, path: str) -> DataFrame:
    """Trades of dump files as text; see ``parsed_trades``."""
    return parsed_trades(spark.read.text(path))


def parsed_trades(lines: DataFrame) -> DataFrame:
    """Trades of lines (id, price, quantity, first, last, time, buyer is maker, best match) with or without a header; rows with an unreadable number are left out."""
    f = F.split("value", ",")
    at = lambda k: F.trim(F.get(f, F.lit(k)))
    rows = lines.select(
        at(0).try_cast("long").alias("trade_id"), at(1).try_cast("double").alias("price"), at(2).try_cast("double").alias("qty"),
        millis(at(5).try_cast("long")).alias("ts_ms"), (F.lower(at(6)) == "true").alias("is_buyer_maker"),
    )
    return rows.dropna(subset=["trade_id", "price", "qty", "ts_ms"])


def metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    """Metrics by (symbol, ts_ms) of dump files (UTC time, symbol, open interest, its value, four ratios); of repeated keys the last row counts, by file name and place."""
    names = ["open_interest", "open_interest_value", "top_count_ratio", "top_ratio", "ratio", "taker_ratio"]
    f = F.split("value", ",")
    at = lambda k: F.trim(F.get(f, F.lit(k)))
    time = F.try_to_timestamp(at(0), F.lit("yyyy-MM-dd HH:mm:ss"))
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    rows = spark.read.text(path).select(F.unix_millis(time).alias("ts_ms"), at(1).alias("symbol"), F.struct(*(at(k + 2).try_cast("double").alias(n) for k, n in enumerate(names))).alias("m"), place.alias("place"))
    return rows.filter("ts_ms IS NOT NULL").groupBy("symbol", "ts_ms").agg(F.max_by("m", "place").alias("m")).select("symbol", "ts_ms", "m.*")


def klines(payload: Column) -> Column:
    """Candles of a message of arrays, decoded by position: open time, open, high, low, close, volume."""
    number = lambda x, k: F.get(x, F.lit(k)).try_cast("double")
    rows = F.from_json(payload, "array<array<string>>")
    return F.transform(rows, lambda x: F.struct(
        F.get(x, F.lit(0)).try_cast("long").alias("open_time"), number(x, 1).alias("open"), number(x, 2).alias("high"), number(x, 3).alias("low"), number(x, 4).alias("close"), number(x, 5).alias("volume"),
    ))


def points(payload: Column) -> Column:
    """Points (t, p) of a price series; those without time or price are dropped."""
    found = F.from_json(payload, "history array<struct<t: long, p: double>>")["history"]
    return F.filter(found, lambda x: x["t"].isNotNull() & x["p"].isNotNull())


def order_book(payload: Column) -> Column:
    """struct(bid, ask, imbalance, best_bid, best_ask, spread): notional sums, their balance (0 without any), and the first level of either side (0 without one)."""
    book = F.from_json(payload, "bids array<array<string>>, asks array<array<string>>")
    number = lambda level, k: F.get(level, F.lit(k)).try_cast("double")
    notional = lambda side: F.coalesce(F.aggregate(book[side], F.lit(0.0), lambda a, x: a + number(x, 0) * number(x, 1)), F.lit(0.0))
    best = lambda side: F.coalesce(number(F.get(book[side], F.lit(0)), 0), F.lit(0.0))
    bid, ask = notional("bids"), notional("asks")
    return F.struct(bid.alias("bid"), ask.alias("ask"), F.when(bid + ask > 0, (bid - ask) / (bid + ask)).otherwise(0.0).alias("imbalance"), best("bids").alias("best_bid"), best("asks").alias("best_ask"), (best("asks") - best("bids")).alias("spread"))


def trade_flow(trades: DataFrame, *keys: str) -> DataFrame:
    """Notional bought and sold by takers, the buyers' share (0.5 without trades of any size), and the mean size."""
    size = F.col("price") * F.col("qty")
    g = trades.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.when(F.col("is_buyer_maker"), 0.0).otherwise(size)).alias("buy"), F.sum(F.when(F.col("is_buyer_maker"), size).otherwise(0.0)).alias("sell"))
    total = F.col("buy") + F.col("sell")
    return g.select(*keys, "n", "buy", "sell", F.when(total > 0, F.col("buy") / total).otherwise(0.5).alias("pressure"), (total / F.col("n")).alias("avg_size"))


def interest_delta(payload: Column, back: int = 13) -> Column:
    """struct(latest, short, long): the last open interest of a list of bins, and its change in percent from one bin before and, in a full list of ``back``, from the first (0 where there is none)."""
    bins = F.transform(F.from_json(payload, "array<struct<sumOpenInterest: string>>"), lambda x: x["sumOpenInterest"].try_cast("double"))
    n, last = F.size(bins), F.coalesce(F.try_element_at(bins, F.lit(-1)), F.lit(0.0))
    change = lambda base, least: F.when((n >= least) & (base != 0), F.round((last - base) / base * 100, 3)).otherwise(0.0)
    return F.struct(last.alias("latest"), change(F.try_element_at(bins, F.lit(-2)), 2).alias("short"), change(F.try_element_at(bins, F.lit(1)), back).alias("long"))


def premium(payload: Column) -> Column:
    """struct(funding_rate, mark_price, next_funding) of a premium message."""
    get = lambda k, t: F.get_json_object(payload, f"$.{k}").try_cast(t)
    return F.struct(get("lastFundingRate", "double").alias("funding_rate"), get("markPrice", "double").alias("mark_price"), get("nextFundingTime", "long").alias("next_funding"))


def ticker(payload: Column) -> Column:
    """struct(last_price, change_pct, quote_volume) of a day's ticker."""
    get = lambda k: F.get_json_object(payload, f"$.{k}").try_cast("double")
    return F.struct(get("lastPrice").alias("last_price"), get("priceChangePercent").alias("change_pct"), get("quoteVolume").alias("quote_volume"))


def long_short(payload: Column) -> Column:
    """struct(ratio, long_pct, short_pct) of the first entry of a list; NULLs without one."""
    first = F.get(F.from_json(payload, "array<struct<longShortRatio: string, longAccount: string, shortAccount: string>>"), F.lit(0))
    get = lambda k: first[k].try_cast("double")
    return F.struct(get("longShortRatio").alias("ratio"), (get("longAccount") * 100).alias("long_pct"), (get("shortAccount") * 100).alias("short_pct"))


def outcomes(prices: Column, tokens: Column) -> Column:
    """struct(yes, no, token): prices of a JSON list of strings, half and half unless both can be read, and the first of a list of tokens."""
    p = F.from_json(prices, "array<string>")
    price = lambda k: F.try_element_at(p, F.lit(k)).try_cast("double")
    both = price(1).isNotNull() & price(2).isNotNull()
    pick = lambda k: F.when(both, price(k)).otherwise(0.5)
    return F.struct(pick(1).alias("yes"), pick(2).alias("no"), F.try_element_at(F.from_json(tokens, "array<string>"), F.lit(1)).alias("token"))
