"""Range, as-of, semi, anti, cross and fallback joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog import query
from tidemill.operators import joins as jo
from tidemill.sources import decisions as de
from tidemill.sources import market as mk

_H, _DAY = mk.HOUR, 86_400_000


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _probes(spark, sf_dir):
    """Probe times: noon of every order's day, by priority."""
    return de.quotes(spark, sf_dir).select("key", F.col("quote_id").alias("probe_id"), (F.col("observed_at") - 43_200_000 + F.pmod("quote_id", F.lit(5)) * _DAY).alias("target"))


@query(
    "join_asof_quote",
    f"""WITH {de.QUOTES_SQL}, l AS (SELECT key, quote_id AS probe_id, observed_at - 43200000 + quote_id % 5 * {_DAY} AS target FROM quotes),
r AS (SELECT key, observed_at, max(quote_id) AS quote_id FROM quotes GROUP BY ALL)
SELECT l.key, l.probe_id, l.target, r.observed_at, r.quote_id FROM l ASOF LEFT JOIN r ON l.key = r.key AND l.target >= r.observed_at""",
)
def join_asof_quote(spark, sf_dir):
    """The latest quote of the key at or before the target; of equal times the greatest id."""
    return jo.asof(_probes(spark, sf_dir), de.quotes(spark, sf_dir), ["key"], "target", "observed_at", ["observed_at", "quote_id"], block=30 * _DAY)


@query(
    "join_htf_close_time",
    f"""{de.with_sql(mk.candles_sql("htf", 4 * _H))}, l AS (SELECT symbol, anchor_open, least(anchor_open + 2 * {_H} - 1, anchor_open + {_H}) - 4 * {_H} AS lim FROM decisions)
SELECT l.symbol, l.anchor_open, h.open_time AS htf_open, h.close AS htf_close FROM l ASOF LEFT JOIN htf h ON l.symbol = h.symbol AND l.lim >= h.open_time""",
)
def join_htf_close_time(spark, sf_dir):
    """Each decision with the last four-hour candle that is closed by then."""
    htf = mk.candles(mk.trades(spark, sf_dir), 4 * _H).withColumnRenamed("close", "htf_close")
    d = de.decisions(spark, sf_dir).select("symbol", "anchor_open")
    return jo.close_time_asof(d, htf, _H, 4 * _H, ["htf_close"])


@query("join_target_lead", f"{de.with_sql()} SELECT symbol, anchor_open, target_open, target_open_price, target_close, outcome_up FROM decisions")
def join_target_lead(spark, sf_dir):
    return de.decisions(spark, sf_dir).select("symbol", "anchor_open", "target_open", "target_open_price", "target_close", "outcome_up")


@query(
    "join_range_slice",
    f"""{mk.with_sql(mk.candles_sql())} SELECT d.symbol, d.open_time AS anchor_open, count(*) AS n, round(min(c.low), 6) + 0.0 AS low, round(avg(c.close), 6) + 0.0 AS mean
FROM candles d JOIN candles c ON d.symbol = c.symbol AND c.open_time BETWEEN d.open_time - 24 * {_H} AND d.open_time GROUP BY ALL""",
)
def join_range_slice(spark, sf_dir):
    """What a decision sees of the last day: a time range, said as a window frame and not as a join."""
    w = mk.series().rangeBetween(-24 * _H, 0)
    c = mk.candles(mk.trades(spark, sf_dir))
    return mk.rounded(c.select("symbol", F.col("open_time").alias("anchor_open"), F.count("*").over(w).alias("n"), F.min("low").over(w).alias("low"), F.avg("close").over(w).alias("mean")))


@query("join_prediction_candle", f"{de.with_sql()} SELECT d.symbol, d.target_open, p_up, c.close AS actual_close, round(abs(c.close - d.close) / d.close * 100, 6) + 0.0 AS error_pct, CASE WHEN p_up <> 0.5 THEN (p_up >= 0.5) = (c.close > c.open) END AS hit FROM decisions d JOIN candles c ON d.symbol = c.symbol AND d.target_open = c.open_time")
def join_prediction_candle(spark, sf_dir):
    """Predictions resolved by the candle they were made for; the hit is NULL where p is 0.5."""
    d = de.decisions(spark, sf_dir).select("symbol", "target_open", "p_up", F.col("close").alias("anchor_close"))
    c = mk.candles(mk.trades(spark, sf_dir)).select("symbol", F.col("open_time").alias("target_open"), F.col("close").alias("actual_close"), (F.col("close") > F.col("open")).alias("up"))
    out = d.join(c, ["symbol", "target_open"])
    error = F.abs(F.col("actual_close") - F.col("anchor_close")) / F.col("anchor_close") * 100
    return mk.rounded(out.select("symbol", "target_open", "p_up", "actual_close", error.alias("error_pct"), F.when(F.col("p_up") != 0.5, (F.col("p_up") >= 0.5) == F.col("up")).alias("hit")))


@query("join_semi_exposure", "SELECT o_custkey, count(*) AS open_orders FROM orders o WHERE o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c_acctbal > 0) GROUP BY o_custkey")
def join_semi_exposure(spark, sf_dir):
    """Open orders of customers in credit."""
    active = _table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    o = _table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    return o.join(active, o["o_custkey"] == active["c_custkey"], "left_semi").groupBy("o_custkey").agg(F.count("*").alias("open_orders"))


@query(
    "join_anti_missing",
    f"""{mk.with_sql(mk.candles_sql())}, a AS (SELECT symbol, unnest(range(min(open_time), max(open_time) + 1, {_H})) AS open_time FROM candles GROUP BY symbol)
SELECT symbol, open_time FROM a WHERE NOT EXISTS (SELECT 1 FROM candles d WHERE d.trades >= 3 AND d.symbol = a.symbol AND d.open_time = a.open_time)""",
)
def join_anti_missing(spark, sf_dir):
    """Hours of the grid without a candle of three trades."""
    c = mk.candles(mk.trades(spark, sf_dir))
    grid = c.groupBy("symbol").agg(F.explode(F.sequence(F.min("open_time"), F.max("open_time"), F.lit(_H))).alias("open_time"))
    return grid.join(c.filter("trades >= 3"), ["symbol", "open_time"], "left_anti")


@query("join_cross_combo", "SELECT DISTINCT event_type AS symbol, i.interval, w.window_len FROM events, (VALUES ('1m'), ('5m'), ('15m')) i(interval), (VALUES (50), (200)) w(window_len)")
def join_cross_combo(spark, sf_dir):
    """Symbols by intervals by window lengths: fixed short lists beside the symbols."""
    symbols = _table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")).distinct()
    return symbols.withColumn("interval", F.explode(F.array(*map(F.lit, ("1m", "5m", "15m"))))).withColumn("window_len", F.explode(F.array(F.lit(50), F.lit(200))))


@query("join_demand", "SELECT event_type AS symbol, count(*) AS n FROM events WHERE event_type IN (SELECT event_type FROM events WHERE value > 100 GROUP BY event_type HAVING count(*) > 10) GROUP BY event_type")
def join_demand(spark, sf_dir):
    """Only symbols for which there is demand."""
    e = _table(spark, sf_dir, "events")
    demand = e.filter("value > 100").groupBy("event_type").count().filter("count > 10")
    return e.join(demand, "event_type", "left_semi").groupBy(F.col("event_type").alias("symbol")).agg(F.count("*").alias("n"))


@query("join_one_to_many", "SELECT c_custkey, count(o_orderkey) AS n, coalesce(round(sum(o_totalprice), 2), 0) + 0.0 AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_one_to_many(spark, sf_dir):
    """Sessions with their bets, also those without: customers and orders stand in."""
    c, o = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    totals = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    j = c.join(totals, c["c_custkey"] == totals["o_custkey"], "left")
    return j.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.round("total", 2), F.lit(0.0)).alias("total"))


@query(
    "join_fallback_resolve",
    """WITH r AS (SELECT c_custkey, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS rank, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey)
SELECT c_custkey, o_orderkey FROM r QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY rank, o_orderdate, o_orderkey) = 1""",
)
def join_fallback_resolve(spark, sf_dir):
    """The best-ranked candidate, then the oldest: an override before a default before anything."""
    c, o = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(3)
    j = c.join(o, c["c_custkey"] == o["o_custkey"]).withColumn("rank", rank)
    return jo.top1(j, ["c_custkey"], [F.col("rank"), F.col("o_orderdate"), F.col("o_orderkey")]).select("c_custkey", "o_orderkey")


@query(
    "join_nearest_window",
    f"""{mk.with_sql(mk.candles_sql("a", 4 * _H), mk.candles_sql("b", 3 * _H))} SELECT a.symbol, a.open_time, arg_min(b.open_time, (abs(a.open_time - b.open_time), b.open_time)) AS nearest, min(abs(a.open_time - b.open_time)) AS distance
FROM a JOIN b ON a.symbol = b.symbol AND abs(a.open_time - b.open_time) <= 6 * {_H} GROUP BY a.symbol, a.open_time""",
)
def join_nearest_window(spark, sf_dir):
    """The market window nearest to a candle within six hours, an exact one first: candidates meet by coarse bucket."""
    t = mk.trades(spark, sf_dir)
    reach = 6 * _H
    a = mk.candles(t, 4 * _H).select("symbol", "open_time").withColumn("slot", F.explode(F.array(*(F.expr(f"open_time div {reach} + {k}") for k in (-1, 0, 1)))))
    b = mk.candles(t, 3 * _H).select("symbol", F.col("open_time").alias("other")).withColumn("slot", F.expr(f"other div {reach}"))
    near = a.join(b, ["symbol", "slot"]).withColumn("distance", F.abs(F.col("open_time") - F.col("other"))).filter(F.col("distance") <= reach)
    return near.groupBy("symbol", "open_time").agg(F.min_by("other", F.struct("distance", "other")).alias("nearest"), F.min("distance").alias("distance"))


@query(
    "join_alts_grid",
    f"""{mk.with_sql(mk.candles_sql())} SELECT open_time, max(close) FILTER (WHERE symbol = 'click') AS click, max(close) FILTER (WHERE symbol = 'purchase') AS purchase, max(close) FILTER (WHERE symbol = 'view') AS view FROM candles GROUP BY open_time""",
)
def join_alts_grid(spark, sf_dir):
    """Many series on one grid: a pivot in one shuffle, not a join a series."""
    c = mk.candles(mk.trades(spark, sf_dir))
    names = ("click", "purchase", "view")
    return c.groupBy("open_time").pivot("symbol", names).agg(F.max("close"))


@query("join_merge_validated", f"{mk.with_sql(mk.candles_sql(), mk.bars_sql())} SELECT c.symbol, c.open_time, close, trade_count FROM candles c JOIN bars b ON c.symbol = b.symbol AND c.open_time = b.open_time")
def join_merge_validated(spark, sf_dir):
    """A one-to-one merge that fails on repeated keys."""
    t = mk.trades(spark, sf_dir)
    keys = ["symbol", "open_time"]
    return jo.unique_key(mk.candles(t), keys).join(jo.unique_key(mk.bars(t), keys), keys).select(*keys, "close", "trade_count")


@query(
    "join_available_asof",
    f"""{de.with_sql(mk.bars_sql())}, m AS (SELECT symbol, open_time + {2 * mk.HOUR} AS known_at, open_time AS measured_at, buy_volume - sell_volume AS flow FROM bars)
SELECT d.symbol, d.anchor_open, m.measured_at, round(m.flow, 6) + 0.0 AS flow FROM decisions d ASOF LEFT JOIN m ON d.symbol = m.symbol AND d.anchor_open >= m.known_at""",
)
def join_available_asof(spark, sf_dir):
    """Decisions with the latest metric that was known by then: a bar's flow is published an hour after the bar has ended."""
    b = mk.bars(mk.trades(spark, sf_dir))
    m = b.select("symbol", (F.col("open_time") + 2 * mk.HOUR).alias("known_at"), F.col("open_time").alias("measured_at"), (F.col("buy_volume") - F.col("sell_volume")).alias("flow"))
    d = de.decisions(spark, sf_dir).select("symbol", "anchor_open")
    return mk.rounded(jo.asof(d, m, ["symbol"], "anchor_open", "known_at", ["measured_at", "flow"], block=64 * mk.HOUR))
