"""Rolling and cumulative features over hourly candles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.catalog import query
from tidemill.operators import events, order
from tidemill.operators import rolling as ro
from tidemill.sources import market as mk

_C = mk.candles_sql()
_P = "PARTITION BY symbol ORDER BY open_time"


def _w(n: int) -> str:
    return f"({_P} ROWS {n - 1} PRECEDING)"


def _candles(spark, sf_dir, interval: int = mk.HOUR):
    """Candles with the log return r of the close."""
    c = mk.candles(mk.trades(spark, sf_dir), interval)
    return c.withColumn("r", F.ln(F.col("close") / F.lag("close").over(mk.series())))


_R = f"s AS (SELECT *, ln(close / lag(close) OVER ({_P})) AS r FROM candles)"


def _win(name: str, sql: dict[str, str], build, more: str = _R, source: str = "s", digits: int = 6, interval: int = mk.HOUR) -> None:
    cols = ", ".join(f"{e} AS {n}" if e.startswith("=") is False and n.startswith("i_") else f"round({e}, {digits}) + 0.0 AS {n}" for n, e in sql.items())

    @query(name, f"{mk.with_sql(mk.candles_sql(interval=interval), more)} SELECT symbol, open_time, {cols} FROM {source}")
    def run(spark, sf_dir):
        return mk.rounded(build(_candles(spark, sf_dir, interval)), digits)


def _full(n: int, e: str, c: str = "r") -> str:
    return f"CASE WHEN count({c}) OVER {_w(n)} = {n} THEN {e} END"


_win(
    "win_rolling",
    {f"{k}_{n}": _full(n, f"{f}(r) OVER {_w(n)}") for n in (12, 48) for k, f in (("mean", "avg"), ("std", "stddev_samp"), ("sum", "sum"), ("min", "min"), ("max", "max"))},
    lambda c: ro.rolling(c, "r", (12, 48)),
)
_win("win_zscore_sample", {"z48": _full(48, f"(r - avg(r) OVER {_w(48)}) / (stddev_samp(r) OVER {_w(48)} + 1e-12)")}, lambda c: c.select("symbol", "open_time", ro.sample_z(F.col("r"), 48).alias("z48")))
_win(
    "win_runlength",
    {"i_run": f"row_number() OVER (PARTITION BY symbol, island ORDER BY open_time) * CAST(sg AS BIGINT)"},
    ro.run_length,
    more=f"{_R}, t AS (SELECT *, coalesce(sign(r), 0) AS sg FROM s), u AS (SELECT *, CASE WHEN sg IS DISTINCT FROM lag(sg) OVER ({_P}) THEN 1 ELSE 0 END AS ch FROM t), v AS (SELECT *, sum(ch) OVER ({_P}) AS island FROM u)",
    source="v",
)
_win("win_prank", {"prank": "(len(list_filter(a, lambda x: x < close)) + (len(list_filter(a, lambda x: x = close)) + 1) / 2.0) / len(a)"}, lambda c: c.select("symbol", "open_time", ro.percent_rank("close", 60).alias("prank")), more=f"{_R}, t AS (SELECT *, list(close) OVER {_w(60)} AS a FROM s)", source="t")
_win("win_rolling_median", {"med": f"quantile_cont(close, 0.5) OVER {_w(30)}"}, lambda c: c.select("symbol", "open_time", F.percentile("close", 0.5).over(ro.last(30)).alias("med")))
def _order_query(name: str, bars: int, quantiles: dict[str, float]) -> None:
    frame = f"a.symbol = b.symbol AND b.i BETWEEN a.i - {bars - 1} AND a.i"
    cols = ", ".join(f"round(quantile_cont(b.close, {q}), 6) + 0.0 AS {k}" for k, q in quantiles.items())
    numbered = f"n AS (SELECT symbol, open_time, close, row_number() OVER ({_P}) AS i FROM candles)"

    @query(name, f"""{mk.with_sql(mk.candles_sql(interval=_FIVE), numbered)}
SELECT a.symbol, a.open_time, round((count(*) FILTER (WHERE b.close < a.close) + (count(*) FILTER (WHERE b.close = a.close) + 1) / 2.0) / count(*), 6) + 0.0 AS prank, {cols}
FROM n a JOIN n b ON {frame} GROUP BY a.symbol, a.open_time""")
    def run(spark, sf_dir):
        """Percentile rank and quantiles of five-minute closes over a frame of thousands of bars."""
        return mk.rounded(order.order_statistics(mk.candles(mk.trades(spark, sf_dir), _FIVE), "close", bars, _FIVE, quantiles))


_FIVE = 5 * mk.MINUTE
_order_query("win_prank_30d", 30 * 288, {"med": 0.5})
_order_query("win_prank_90d", 90 * 288, {"q10": 0.1, "q90": 0.9})

_win(
    "win_corr_beta",
    {"corr": _full(48, f"corr(r, dv) OVER {_w(48)}"), "cov": _full(48, f"covar_samp(r, dv) OVER {_w(48)}"), "beta": _full(48, f"covar_samp(r, dv) OVER {_w(48)} / nullif(var_samp(dv) OVER {_w(48)}, 0)")},
    ro.corr_beta,
    more=f"{_R}, t AS (SELECT *, ln((volume + 1) / (lag(volume) OVER ({_P}) + 1)) AS dv FROM s)", source="t",
)
_win("win_roll_spread", {"roll": f"CASE WHEN count(rl) OVER {_w(48)} = 48 THEN 2 * sqrt(greatest(-covar_samp(r, rl) OVER {_w(48)}, 0)) END"}, ro.roll_spread, more=f"{_R}, t AS (SELECT *, lag(r) OVER ({_P}) AS rl FROM s)", source="t")
_win("win_efficiency", {"er12": f"CASE WHEN count(d) OVER {_w(12)} = 12 THEN abs(close - lag(close, 12) OVER ({_P})) / nullif(sum(d) OVER {_w(12)}, 0) END"}, ro.efficiency, more=f"{_R}, t AS (SELECT *, abs(close - lag(close) OVER ({_P})) AS d FROM s)", source="t")
_win("win_vwap_dev", {"vwap_dev": f"CASE WHEN count(*) OVER {_w(12)} = 12 THEN close / nullif(sum(close * volume) OVER {_w(12)} / nullif(sum(volume) OVER {_w(12)}, 0), 0) - 1 END"}, ro.vwap_deviation)
_GK = "0.5 * ln(high / low) * ln(high / low) - (2 * ln(2.0::DOUBLE) - 1) * ln(close / open) * ln(close / open)"
_win("win_gk_vol", {"rv_gk": f"CASE WHEN count(*) OVER {_w(12)} = 12 THEN sqrt(greatest(avg(gk) OVER {_w(12)}, 0)) END"}, ro.garman_klass, more=f"{_R}, t AS (SELECT *, {_GK} AS gk FROM s)", source="t")
_win("win_vol_of_vol", {"vov": f"CASE WHEN count(sd) OVER {_w(48)} = 48 THEN stddev_samp(sd) OVER {_w(48)} END"}, ro.vol_of_vol, more=f"{_R}, t AS (SELECT *, {_full(12, f'stddev_samp(r) OVER {_w(12)}')} AS sd FROM s)", source="t")
_win("win_drawdown", {"peak": f"max(close) OVER ({_P})", "drawdown": f"max(close) OVER ({_P}) - close"}, ro.drawdown)
_win("win_lag_matrix", {**{f"lag_{k}": f"lag(r, {k}) OVER ({_P})" for k in range(6)}}, lambda c: c.select("symbol", "open_time", *(F.lag("r", k).over(mk.series()).alias(f"lag_{k}") for k in range(6))))
_win("win_recent_max", {"recent_max": f"max(abs(r)) OVER {_w(6)}", "decel": f"CAST(abs(r) < max(abs(r)) OVER {_w(6)} AS DOUBLE)"}, ro.recent_max)
_win("win_signed_flow", {"flow": f"CASE WHEN count(f) OVER {_w(6)} = 6 THEN avg(f) OVER {_w(6)} END"}, ro.signed_flow, more=f"{_R}, t AS (SELECT *, sign(r) * volume AS f FROM s)", source="t")
_SHAPE = {"body_range": "(close - open) / nullif(high - low, 0)", "wick_up": "(high - greatest(open, close)) / nullif(high - low, 0)", "wick_dn": "(least(open, close) - low) / nullif(high - low, 0)"}
_win("win_candle_shape", _SHAPE, ro.candle_shape)
_win("win_forward_return", {"pct_3": f"close / lag(close, 3) OVER ({_P}) - 1", "fwd_2": f"lead(close, 2) OVER ({_P}) / close - 1"}, lambda c: c.select("symbol", "open_time", (F.col("close") / F.lag("close", 3).over(mk.series()) - 1).alias("pct_3"), (F.lead("close", 2).over(mk.series()) / F.col("close") - 1).alias("fwd_2")))
_win("win_funding_cycle", {"mins": "CAST((28800000 - open_time % 28800000) / 60000 AS DOUBLE)", "cyc_sin": "sin(2 * pi() * (open_time % 28800000) / 28800000.0)", "cyc_cos": "cos(2 * pi() * (open_time % 28800000) / 28800000.0)"}, ro.funding_cycle)
for _name, _width in (("win_ewm", mk.HOUR), ("win_ewm_minute", mk.MINUTE)):
    _win(
        _name,
        {"ewm_adj": "CASE WHEN len(a) > 0 THEN list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i] * pow(1 - 2.0 / 13, len(a) - i))) / list_sum(list_transform(range(1, len(a) + 1), lambda i: pow(1 - 2.0 / 13, len(a) - i))) END",
         "ewm_rec": "list_reduce(list_slice(a, 2, len(a)), lambda e, x: x * (2.0 / 13)::DOUBLE + e * (1 - 2.0 / 13)::DOUBLE, a[1])"},
        lambda c: ro.ewm(c, "close", 2 / 13),
        more=f"{_R}, t AS (SELECT *, list(close) OVER ({_P}) AS a FROM s)", source="t", interval=_width,
    )


_W = "pow(1 - 2.0 / 13, len(a) - i)"
_SUM = lambda e: f"list_sum(list_transform(range(1, len(a) + 1), lambda i: {e}))"
_win(
    "win_ewm_std",
    {"ewm_std": f"CASE WHEN len(a) > 1 THEN sqrt({_SUM(f'{_W} * (a[i] - m) * (a[i] - m)')} / {_SUM(_W)} * {_SUM(_W)} * {_SUM(_W)} / ({_SUM(_W)} * {_SUM(_W)} - {_SUM(f'{_W} * {_W}')})) END"},
    lambda c: ro.ewm_std(c, "close", 2 / 13),
    more=f"{_R}, q AS (SELECT *, list(close) OVER ({_P}) AS a FROM s), t AS (SELECT *, {_SUM(f'{_W} * a[i]')} / {_SUM(_W)} AS m FROM q)", source="t", digits=5,
)


@query("win_ffill_limit", f"""{mk.with_sql(_C)}, r AS (SELECT symbol, unnest(range(min(open_time), max(open_time) + 1, {mk.HOUR})) AS open_time FROM candles GROUP BY symbol),
g AS (SELECT r.symbol, r.open_time, close FROM r LEFT JOIN candles c ON r.symbol = c.symbol AND r.open_time = c.open_time)
SELECT symbol, open_time, last_value(close IGNORE NULLS) OVER {_w(4)} AS ffill3, first_value(close IGNORE NULLS) OVER ({_P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bfill FROM g""")
def win_ffill_limit(spark, sf_dir):
    """Forward fill over at most three holes of the grid, and backward fill."""
    c = mk.candles(mk.trades(spark, sf_dir))
    grid = c.groupBy("symbol").agg(F.explode(F.sequence(F.min("open_time"), F.max("open_time"), F.lit(mk.HOUR))).alias("open_time"))
    g = grid.join(c, ["symbol", "open_time"], "left")
    return g.select("symbol", "open_time", F.last("close", ignorenulls=True).over(ro.last(4)).alias("ffill3"), F.first("close", ignorenulls=True).over(mk.series().rowsBetween(0, Window.unboundedFollowing)).alias("bfill"))


@query("win_top1_latest", f"{mk.with_sql(_C)} SELECT symbol, max(open_time) AS open_time, arg_max(close, open_time) AS close FROM candles GROUP BY symbol")
def win_top1_latest(spark, sf_dir):
    c = mk.candles(mk.trades(spark, sf_dir))
    return c.groupBy("symbol").agg(F.max("open_time").alias("open_time"), F.max_by("close", "open_time").alias("close"))


def _smooth(c: str) -> str:
    """Wilder's mean of 14 of a series' rows so far, as a list expression."""
    return f"list_reduce(list_slice({c}, 2, len({c})), lambda e, x: x * (1.0 / 14)::DOUBLE + e * (1 - 1.0 / 14)::DOUBLE, {c}[1])"


_ADX = f"""d AS (SELECT *, high - lag(high) OVER ({_P}) AS up, lag(low) OVER ({_P}) - low AS down, greatest(high - low, coalesce(abs(high - lag(close) OVER ({_P})), 0), coalesce(abs(low - lag(close) OVER ({_P})), 0)) AS tr FROM candles),
a AS (SELECT symbol, open_time, list(tr) OVER w AS tr, list(CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END) OVER w AS plus, list(CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END) OVER w AS minus FROM d WINDOW w AS ({_P} ROWS UNBOUNDED PRECEDING)),
m AS (SELECT symbol, open_time, 100 * {_smooth("plus")} / ({_smooth("tr")} + 1e-12) AS p, 100 * {_smooth("minus")} / ({_smooth("tr")} + 1e-12) AS m FROM a WHERE len(tr) >= 14),
x AS (SELECT symbol, open_time, (p - m) / (p + m + 1e-12) AS dmi, list(100 * abs(p - m) / (p + m + 1e-12)) OVER ({_P} ROWS UNBOUNDED PRECEDING) AS dx FROM m)"""


def _adx_query(name: str, interval: int) -> None:
    @query(name, f"{mk.with_sql(mk.candles_sql(interval=interval), _ADX)} SELECT symbol, open_time, round(CASE WHEN len(dx) >= 14 THEN {_smooth('dx')} / 100 END, 6) + 0.0 AS adx, round(dmi, 6) + 0.0 AS dmi FROM x")
    def win_adx(spark, sf_dir):
        """ADX and DMI by Wilder's smoothing, whose memory never ends: sums in blocks, carried over."""
        return mk.rounded(ro.adx(mk.candles(mk.trades(spark, sf_dir), interval)))


_adx_query("win_adx", mk.HOUR)
_adx_query("win_adx_minute", mk.MINUTE)


@query("win_zero_crossings", f"{mk.with_sql(_C, _R)}, t AS (SELECT *, sign(r) AS sg, last_value(nullif(sign(r), 0) IGNORE NULLS) OVER ({_P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s) SELECT symbol, open_time, CAST(sum(CASE WHEN sg <> 0 AND b <> sg THEN 1 ELSE 0 END) OVER ({_P} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS crossings FROM t")
def win_zero_crossings(spark, sf_dir):
    """How often returns have changed sign so far; zeros keep the sign before them."""
    w = mk.series()
    sign = F.signum("r")
    before = F.last(F.nullif(sign, F.lit(0.0)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    c = _candles(spark, sf_dir).withColumn("turn", F.coalesce(((sign != 0) & (before != sign)).cast("long"), F.lit(0)))
    return c.select("symbol", "open_time", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("crossings"))


def _z(e: str, n: int) -> str:
    return f"(CASE WHEN count({e}) OVER {_w(n)} = {n} THEN ({e} - avg({e}) OVER {_w(n)}) / (stddev_samp({e}) OVER {_w(n)} + 1e-12) END)"


_EVENTS = {
    "cascade": f"(sign(r) <> 0 AND sign(r) = sign(lag(r) OVER ({_P})) AND sign(r) = sign(lag(r, 2) OVER ({_P}))) OR abs(r) < 0.5 * max(abs(r)) OVER {_w(6)}",
    "flush": f"{_z('volume', 24)} > 2 AND r < 0",
    "premium": f"abs({_z('dev', 96)}) > 2",
    "prefunding": f"open_time % (8 * {mk.HOUR}) >= 7 * {mk.HOUR} AND abs({_z('r', 24)}) > 1.5",
    "cross_gap": f"abs({_z('gap', 24)}) > 2 AND (open_time // {mk.HOUR}) % 24 BETWEEN 14 AND 20",
}
_GATE = f"d AS (SELECT *, close / avg(close) OVER {_w(12)} - 1 AS dev, close / avg(close) OVER (PARTITION BY open_time) - 1 AS gap FROM s), g AS (SELECT symbol, open_time, coalesce((close - low) / nullif(high - low, 0), 0.5) AS p, {', '.join(f'coalesce({e}, false) AS {n}' for n, e in _EVENTS.items())} FROM d)"


@query("model_event_gate_score", f"{mk.with_sql(_C, _R, _GATE)} SELECT symbol, open_time, {', '.join(_EVENTS)}, round(CASE WHEN {' OR '.join(_EVENTS)} THEN abs(p - 0.5) ELSE -1.0 END, 6) + 0.0 AS score FROM g")
def model_event_gate_score(spark, sf_dir):
    """Five mechanisms of forced flow, and the confidence of a candle's close in its range where one of them is active."""
    p = F.coalesce((F.col("close") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), F.lit(0.5))
    e = events.mechanisms(_candles(spark, sf_dir))
    return mk.rounded(e.select("symbol", "open_time", *events.MECHANISMS, events.gated(p).alias("score")).withColumnRenamed("cross", "cross_gap"))
