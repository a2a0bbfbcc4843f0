"""What came of bets: on credit, by window, with made-up prices, by batch; and the nodes and messages around them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.catalog import query
from tidemill.operators import equity as eq
from tidemill.plans import flow as fl
from tidemill.queries.models import _r, _training
from tidemill.queries.simulate import _SWEEP, sim_bust_sweep_flat, sim_martingale
from tidemill.sinks import tables as tb
from tidemill.sources import decisions as de
from tidemill.sources import feeds as fd
from tidemill.sources import market as mk

_M, _DAY = eq.MONEY.upper(), 86_400_000


def _equity(stake: str, keys: str, price: float, bank: int, rows: str = "o") -> str:
    """Oracle: the columns of ``equity`` over rows of o, as q."""
    return f"""a AS (SELECT *, CAST({stake} AS {_M}) AS stake FROM {rows}),
b AS (SELECT *, CAST({bank} + sum(CAST(round(CASE WHEN won THEN stake::DOUBLE * {1 - price}::DOUBLE / {price}::DOUBLE ELSE -stake::DOUBLE END, 6) AS {_M})) OVER (PARTITION BY {keys} ORDER BY target_open) AS {_M}) AS after FROM a),
c AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY {keys} ORDER BY target_open), {bank}) AS before, greatest({bank}, max(after) OVER (PARTITION BY {keys} ORDER BY target_open)) - after AS fall FROM b),
q AS (SELECT *, greatest(stake - greatest(before, 0), 0) AS shortfall, stake > greatest(before, 0) OR sign(before) <> sign(after) AS crossed FROM c)"""


@query(
    "agg_equity_borrow",
    f"""{de.with_sql()}, o AS (SELECT symbol, target_open, won, row_number() OVER (PARTITION BY symbol ORDER BY target_open) AS k FROM bets),
l AS (SELECT *, coalesce(k - 1 - max(CASE WHEN won THEN k END) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), k - 1) AS losses FROM o), {_equity("10 * pow(2, losses)", "symbol", 0.5, 100, "l")}
SELECT symbol, count(*) AS bets, arg_max(after, target_open)::DOUBLE AS final, greatest(max(after), 100)::DOUBLE AS peak, least(min(after), 100)::DOUBLE AS trough, max(fall)::DOUBLE AS max_drawdown, greatest(max(shortfall), -min(after), 0)::DOUBLE AS peak_borrowed, count(*) FILTER (WHERE crossed) AS crossings, CAST(max(losses) AS BIGINT) AS max_step FROM q GROUP BY symbol""",
)
def agg_equity_borrow(spark, sf_dir):
    """Doubling stakes from a small bank, on credit: what was borrowed at worst, how often zero was crossed, and the highest doubling."""
    b = sim_martingale(spark, sf_dir).withColumnRenamed("stake", "asked")
    runs = eq.equity(b, ["symbol"], "target_open", F.col("asked"), 0.5, 100.0)
    steps = b.groupBy("symbol").agg(F.max("losses").alias("max_step"))
    return eq.stats(runs, ["symbol"], "target_open", 100.0).join(steps, "symbol")


_SPANS = (7, 14, 365_000)
_CHAOS = f"""f AS (SELECT symbol, min(target_open) AS first, max(target_open) AS last FROM bets GROUP BY symbol), o AS (SELECT b.symbol, span, (target_open - first) // (span::BIGINT * {_DAY}) AS k, target_open, won FROM bets b JOIN f ON f.symbol = b.symbol, (VALUES (7), (14), (365000)) v(span)
  WHERE ((target_open - first) // (span::BIGINT * {_DAY}) + 1) * span * {_DAY} <= last - first + 1), {_equity("10", "symbol, span, k", 0.55, 60)},
r AS (SELECT symbol, span, k, arg_max(after, target_open)::DOUBLE - 60 AS profit, max(shortfall) = 0 AS survived, max(fall)::DOUBLE AS dd, count(*) FILTER (WHERE crossed) AS x FROM q GROUP BY ALL),
g AS (SELECT symbol, span, count(*) AS n, avg((NOT survived)::INT) AS bust_rate, quantile_cont(profit, 0.05) AS p5, quantile_cont(profit, 0.5) AS p50, quantile_cont(profit, 0.95) AS p95, avg(profit) AS mean_profit, max(dd) AS worst_drawdown, avg(x) AS mean_crossings FROM r GROUP BY ALL)"""
_FIELDS = ("p5", "p50", "p95", "mean_profit", "worst_drawdown", "mean_crossings")


@query(
    "agg_chaos_windows",
    f"""{de.with_sql(_CHAOS)} SELECT f.symbol, span, coalesce(n, 0) AS n, {_r("coalesce(bust_rate, 1.0)", "bust_rate", 4)}, {", ".join(_r(f"coalesce({c}, 0.0)", c, 4) for c in _FIELDS)}, coalesce(bust_rate = 0 AND p50 > 0, false) AS passes
FROM f CROSS JOIN (VALUES (7), (14), (365000)) v(span) LEFT JOIN g USING (symbol, span)""",
)
def agg_chaos_windows(spark, sf_dir):
    """Flat stakes over every whole window of some lengths, of which the longest fits nowhere: each window is a run of its own."""
    b = de.bets(spark, sf_dir)
    f = b.groupBy("symbol").agg(F.min("target_open").alias("first"), F.max("target_open").alias("last"))
    combos = f.withColumn("span", F.explode(F.array(*map(F.lit, _SPANS))))
    size = F.col("span").cast("long") * _DAY
    k = F.floor((F.col("target_open") - F.col("first")) / size)
    o = b.select("symbol", "target_open", "won").join(combos, "symbol").withColumn("k", k).filter((F.col("k") + 1) * size <= F.col("last") - F.col("first") + 1)
    keys = ["symbol", "span", "k"]
    runs = eq.equity(o, keys, "target_open", F.lit(10), 0.55, 60.0)
    samples = eq.stats(runs, keys, "target_open", 60.0).join(runs.groupBy(*keys).agg((F.max("shortfall") == 0).alias("survived")), keys)
    return mk.rounded(eq.windows(samples, combos.select("symbol", "span"), ["symbol", "span"], 60.0), 4)


_QUOTED = f"x AS (SELECT symbol, ts_ms // {mk.HOUR} * {mk.HOUR} + {mk.HOUR} AS target_open, max(ts_ms) AS seen FROM trades GROUP BY ALL)"


@query(
    "agg_backtest_synthetic",
    f"""{de.with_sql(_QUOTED)}, s AS (SELECT DISTINCT symbol FROM decisions), p AS (SELECT b.symbol, won, p_up, coalesce(seen < b.target_open - 600000, true) AS synthetic FROM bets b LEFT JOIN x ON x.symbol = b.symbol AND x.target_open = b.target_open WHERE abs(p_up - 0.5) >= 0.01)
SELECT s.symbol, count(won) AS placed, {_r("avg(won::INT)", "hit_rate")}, count(*) FILTER (WHERE synthetic) AS synthetic, {_r("avg(synthetic::INT)", "synthetic_share")}, {_r("avg(won::INT) FILTER (WHERE abs(p_up - 0.5) * 2 >= 0.08)", "gated_hit_rate")} FROM s LEFT JOIN p ON p.symbol = s.symbol GROUP BY s.symbol""",
)
def agg_backtest_synthetic(spark, sf_dir):
    """Of the bets, those without a trade in the ten minutes before, which are priced by a formula: their number and share (NULL without bets), beside the hit-rates."""
    t = mk.trades(spark, sf_dir).groupBy("symbol", (mk.bucket(F.col("ts_ms"), mk.HOUR) + mk.HOUR).alias("target_open")).agg(F.max("ts_ms").alias("seen"))
    b = de.bets(spark, sf_dir).filter(F.abs(F.col("p_up") - 0.5) >= 0.01).join(t, ["symbol", "target_open"], "left")
    b = b.select("symbol", "won", "p_up", F.coalesce(F.col("seen") < F.col("target_open") - 600_000, F.lit(True)).alias("synthetic"))
    share = lambda c: F.avg(c.cast("double"))
    g = b.groupBy("symbol").agg(F.count("*").alias("placed"), share(F.col("won")).alias("hit_rate"), F.count_if("synthetic").alias("synthetic"), share(F.col("synthetic")).alias("synthetic_share"), share(F.when(F.abs(F.col("p_up") - 0.5) * 2 >= 0.08, F.col("won"))).alias("gated_hit_rate"))
    every = de.decisions(spark, sf_dir).select("symbol").distinct().join(g, "symbol", "left")
    return mk.rounded(every.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("placed", "synthetic")}))


@query(
    "agg_bust_status",
    f"{de.with_sql(_SWEEP)}, t AS (SELECT *, CASE WHEN rung = 28 AND symbol < 'd' THEN 'running' WHEN rung = 14 AND symbol < 'c' THEN 'queued' ELSE 'done' END AS status FROM sweep) SELECT symbol, count(*) AS rungs, count(*) FILTER (WHERE status = 'done') AS done, bool_or(status <> 'done') AS pending, bool_or(bust) AS any_bust, min(rung) FILTER (WHERE bust) AS first_bust, max(rung) AS longest FROM t GROUP BY symbol",
)
def agg_bust_status(spark, sf_dir):
    """A batch of which some rungs still run or wait: those done, whether any is pending, and what is known of busts."""
    s = sim_bust_sweep_flat(spark, sf_dir)
    status = F.when((F.col("rung") == 28) & (F.col("symbol") < "d"), "running").when((F.col("rung") == 14) & (F.col("symbol") < "c"), "queued").otherwise("done")
    waits = F.col("status").isin("running", "queued")
    return s.withColumn("status", status).groupBy("symbol").agg(F.count("*").alias("rungs"), F.count_if(~waits).alias("done"), F.bool_or(waits).alias("pending"), F.bool_or("bust").alias("any_bust"), F.min(F.when(F.col("bust"), F.col("rung"))).alias("first_bust"), F.max("rung").alias("longest"))


@query("feed_ticker", f"{mk.with_sql(mk.candles_sql())} SELECT symbol, open_time, close AS last_price, CASE WHEN trades > 1 THEN round((close - open) / open * 100, 6) + 0.0 END AS change_pct, round(volume * close, 6) + 0.0 AS quote_volume FROM candles")
def feed_ticker(spark, sf_dir):
    """Day tickers, some without a readable change."""
    c = mk.candles(mk.trades(spark, sf_dir))
    change = F.when(F.col("trades") > 1, ((F.col("close") - F.col("open")) / F.col("open") * 100).cast("string")).otherwise("n/a")
    payload = F.to_json(F.struct(F.col("close").cast("string").alias("lastPrice"), change.alias("priceChangePercent"), (F.col("volume") * F.col("close")).cast("string").alias("quoteVolume")))
    return mk.rounded(c.select("symbol", "open_time", fd.ticker(payload).alias("m")).select("symbol", "open_time", "m.*"))


@query("feed_long_short", f"{mk.with_sql(mk.bars_sql())} SELECT symbol, open_time, CASE WHEN trade_count % 4 <> 0 THEN round(buy_volume + 1, 6) + 0.0 END AS ratio, CASE WHEN trade_count % 4 <> 0 THEN round(buy_volume, 6) * 100 + 0.0 END AS long_pct, CASE WHEN trade_count % 4 <> 0 THEN round(sell_volume, 6) * 100 + 0.0 END AS short_pct FROM bars")
def feed_long_short(spark, sf_dir):
    """Ratios of top accounts, the first of a list; none in an empty list."""
    b = mk.bars(mk.trades(spark, sf_dir))
    item = F.struct((F.col("buy_volume") + 1).cast("string").alias("longShortRatio"), F.col("buy_volume").cast("string").alias("longAccount"), F.col("sell_volume").cast("string").alias("shortAccount"))
    payload = F.when(F.col("trade_count") % 4 == 0, "[]").otherwise(F.to_json(F.array(item, item)))
    return mk.rounded(b.select("symbol", "open_time", fd.long_short(payload).alias("m")).select("symbol", "open_time", "m.*"))


@query(
    "feed_outcomes",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.5 ELSE (event_id % 10) / 10.0::DOUBLE END AS yes, CASE event_id % 4 WHEN 0 THEN 0.5 ELSE round(1 - (event_id % 10) / 10.0::DOUBLE, 6) END AS no, CASE event_id % 4 WHEN 1 THEN 'tok-' || event_id WHEN 2 THEN 'only' END AS token FROM events""",
)
def feed_outcomes(spark, sf_dir):
    """Prices and the first token of a market's JSON lists; half and half and no token where one can't be read."""
    k = F.col("event_id") % 10
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    prices = F.when(F.col("event_id") % 4 == 0, '["0.3"]').otherwise(F.to_json(F.array((k / 10.0).cast("string"), F.round(1 - k / 10.0, 6).cast("string"))))
    tokens = F.when(F.col("event_id") % 4 == 1, F.to_json(F.array(F.concat(F.lit("tok-"), "event_id"), F.lit("other")))).when(F.col("event_id") % 4 == 2, '["only"]').when(F.col("event_id") % 4 == 3, "{")
    return e.select("event_id", fd.outcomes(prices, tokens).alias("m")).select("event_id", "m.*")


@query(
    "flow_linear_node",
    f"""{mk.with_sql(mk.candles_sql())}, w AS (SELECT *, lag(close, 1) OVER (PARTITION BY symbol ORDER BY open_time) AS a, lag(close, 2) OVER (PARTITION BY symbol ORDER BY open_time) AS b, lead(open) OVER (PARTITION BY symbol ORDER BY open_time) AS anchor FROM candles),
y AS (SELECT *, CASE WHEN b IS NOT NULL THEN 0.5 + 0.9 * close + 0.2 * a - 0.1 * b END AS predicted FROM w)
SELECT symbol, open_time, {_r("predicted", "predicted")}, CASE WHEN anchor IS NOT NULL AND predicted IS NOT NULL THEN CASE WHEN predicted >= anchor THEN 1.0 ELSE 0.0 END END AS p_up, {_r("CASE WHEN anchor <> 0 AND predicted IS NOT NULL THEN least(1.0, abs((predicted - anchor) / anchor) * 10) END", "confidence")} FROM y""",
)
def flow_linear_node(spark, sf_dir):
    """A linear model over a matrix of closes, its direction against the next open; none without an anchor."""
    w = mk.series()
    c = mk.candles(mk.trades(spark, sf_dir)).withColumns({"a": F.lag("close", 1).over(w), "b": F.lag("close", 2).over(w), "anchor": F.lead("open").over(w)})
    out = fl.chain(c, fl.matrix(["close", "a", "b"]), fl.linear([0.9, 0.2, -0.1], 0.5, "anchor"))
    return mk.rounded(out.select("symbol", "open_time", "predicted", "p_up", "confidence"))


_FLOW_OUT = f"""{de.with_sql()}, g AS (SELECT symbol, open_time, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY open_time) AS g FROM candles),
h AS (SELECT symbol, open_time AS anchor_open, CASE WHEN count(g) OVER w = 24 THEN close * quantile_cont(g, 0.05) OVER w END AS p05, CASE WHEN count(g) OVER w = 24 THEN close * quantile_cont(g, 0.5) OVER w END AS p50, CASE WHEN count(g) OVER w = 24 THEN close * quantile_cont(g, 0.95) OVER w END AS p95 FROM g WINDOW w AS (PARTITION BY symbol ORDER BY open_time ROWS 23 PRECEDING))"""


@query(
    "flow_output",
    f"""{_FLOW_OUT} SELECT d.symbol, d.anchor_open, CASE WHEN p_up <> 0.5 THEN p_up END AS p_up, CASE WHEN p_up <> 0.5 THEN round(abs(p_up - 0.5) * 2, 6) + 0.0 ELSE 0.5 END AS confidence, {_r("p50", "predicted")}, {_r("p05", "p05")}, {_r("p50", "p50")}, {_r("p95", "p95")},
  CASE WHEN p_up > 0.5 THEN 'UP' WHEN p_up < 0.5 THEN 'DOWN' END || ' of ' || CAST(CAST(round(close) AS BIGINT) AS VARCHAR) || CASE WHEN p50 IS NULL THEN ', no band yet' ELSE '' END AS reasoning FROM decisions d JOIN h ON h.symbol = d.symbol AND h.anchor_open = d.anchor_open""",
)
def flow_output(spark, sf_dir):
    """All of a prediction in one row: probability, confidence (0.5 where none is given), price, band and reasoning."""
    w = mk.series().rowsBetween(-23, 0)
    c = mk.candles(mk.trades(spark, sf_dir)).withColumn("g", F.col("close") / F.lag("close").over(mk.series()))
    band = lambda q: F.when(F.count("g").over(w) == 24, F.col("close") * F.percentile("g", q).over(w))
    bands = c.select("symbol", F.col("open_time").alias("anchor_open"), band(0.05).alias("p05"), band(0.5).alias("p50"), band(0.95).alias("p95"))
    d = de.decisions(spark, sf_dir).join(bands, ["symbol", "anchor_open"])
    sure = F.when(F.col("p_up") != 0.5, F.col("p_up"))
    why = F.concat(F.when(sure.isNotNull(), de.side(sure)), F.lit(" of "), F.round("close").cast("long").cast("string"), F.when(F.col("p50").isNull(), ", no band yet").otherwise(""))
    out = fl.output(p_up=sure, confidence=F.abs(sure - 0.5) * 2, predicted=F.col("p50"), p05=F.col("p05"), p50=F.col("p50"), p95=F.col("p95"), reasoning=why)
    return mk.rounded(d.select("symbol", "anchor_open", *out))


@query(
    "model_training_rows",
    f"""{mk.with_sql(mk.candles_sql())}, l AS (SELECT *, ln(close / lag(close, 1) OVER w) AS ret_1, ln(close / lag(close, 3) OVER w) AS ret_3, ln(close / lag(close, 5) OVER w) AS ret_5, lead(open, 2) OVER w AS t_open, lead(close, 2) OVER w AS t_close, row_number() OVER w AS k FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY open_time))
SELECT symbol, open_time, (t_close > t_open)::INTEGER AS y, {_r("ret_1", "ret_1")}, {_r("ret_3", "ret_3")}, {_r("ret_5", "ret_5")} FROM l WHERE t_open IS NOT NULL AND k >= 20""",
)
def model_training_rows(spark, sf_dir):
    """The rows that fits read: features and label of every bar that has all of them and a target."""
    rows, _ = _training(spark, sf_dir)
    return mk.rounded(rows.select("symbol", "open_time", "y", "ret_1", "ret_3", "ret_5"))


_HELD = "h AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS payload FROM customer WHERE c_custkey % 2 = 0), t AS (SELECT max(id) AS top FROM h)"


@query(
    "sink_import_policies",
    f"""WITH {_HELD}, c AS (SELECT c_custkey AS id, c_name AS name, 'new ' || c_mktsegment AS payload FROM customer), n AS (SELECT top + id AS id, name, payload FROM c, t WHERE c.id % 2 <> 0)
SELECT 'skip' AS policy, * FROM (SELECT * FROM h UNION ALL SELECT * FROM n) UNION ALL SELECT 'replace', * FROM (SELECT id, name, payload FROM c WHERE id % 2 = 0 UNION ALL SELECT * FROM n) UNION ALL SELECT 'rename', * FROM (SELECT * FROM h UNION ALL SELECT * FROM n UNION ALL SELECT top + id, name || ' (imported)', payload FROM c, t WHERE c.id % 2 = 0)""",
)
def sink_import_policies(spark, sf_dir):
    """A bundle of all sessions, changed, brought to where half are: what is held stays, is replaced under its id, or the newcomer gets another name."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("payload"))
    bundle = c.withColumn("payload", F.concat(F.lit("new "), "payload")).select(F.to_json(F.struct("id", "name", "payload")).alias("bundle"))
    out = [tb.import_sessions(c.filter("id % 2 = 0"), bundle, policy).select(F.lit(policy).alias("policy"), "id", "name", "payload") for policy in tb.POLICIES]
    return out[0].unionByName(out[1]).unionByName(out[2])
