"""Flows compiled to one plan."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.catalog import query
from tidemill.operators import packs
from tidemill.plans import code as cn
from tidemill.plans import flow as fl
from tidemill.queries.indicators import _BASE, _OBV, _W, _z
from tidemill.sources import market as mk

_NAMES = ["ret_1", "ret_3", "ret_5", "px_vs_ema12_atr", "ema_spread_atr", "bb_pos", "atr_pct", "vol_z20", "obv_z20", "up_vol_ratio", "hour_sin", "hour_cos", "is_weekend"]
_WEIGHTS = [round(0.4 - 0.07 * k, 2) for k in range(len(_NAMES))]
_BIAS = -0.02


_HOUR, _DOW = "(hour(make_timestamp(open_time * 1000)) + minute(make_timestamp(open_time * 1000)) / 60.0)", "dayofweek(make_timestamp(open_time * 1000))"
_COLS = {
    "ret_1": "r1", "ret_3": "r3", "ret_5": "r5", "px_vs_ema12_atr": "CASE WHEN n >= 26 AND atr > 0 THEN (close - ema12) / atr END", "ema_spread_atr": "CASE WHEN n >= 26 AND atr > 0 THEN (ema12 - ema26) / atr END", "bb_pos": "CASE WHEN n >= 26 THEN bp END", "atr_pct": "CASE WHEN n >= 26 AND atr > 0 THEN atr / close END",
    "vol_z20": "vz", "obv_z20": "oz", "up_vol_ratio": "uv", "hour_sin": f"sin(2 * pi() * {_HOUR} / 24)", "hour_cos": f"cos(2 * pi() * {_HOUR} / 24)", "is_weekend": f"({_DOW} IN (0, 6))::INTEGER",
}
_Z = " + ".join(f"({w}::DOUBLE) * ({_COLS[c]})" for w, c in zip(_WEIGHTS, _NAMES, strict=True))
_FLOW_SQL = f"""{mk.with_sql(mk.candles_sql(), _BASE, _OBV)}, v AS (SELECT symbol, open_time, {_z("obv")} AS oz, CASE WHEN count(*) OVER w20 = 20 THEN CASE WHEN sum(volume) OVER w20 > 0 THEN sum(CASE WHEN close >= open THEN volume ELSE 0 END) OVER w20 / sum(volume) OVER w20 ELSE 0.5 END END AS uv FROM o {_W}),
f AS (SELECT symbol, open_time, {_Z} + {_BIAS} AS z FROM base JOIN v USING (symbol, open_time))"""


@query("flow_compile", f"{_FLOW_SQL} SELECT symbol, open_time, round(CASE WHEN z IS NULL THEN 0.5 ELSE 1 / (1 + exp(-z)) END, 5) + 0.0 AS p_up FROM f")
def flow_compile(spark, sf_dir):
    """Four packs over hourly candles, thirteen features, a logistic model; 0.5 until every feature is ready."""
    packed = map(fl.pack, (packs.momentum_pack, packs.norm_pack, packs.volume_pack, packs.temporal_pack))
    out = fl.chain(mk.candles(mk.trades(spark, sf_dir)), *packed, fl.matrix(_NAMES), fl.logistic(_WEIGHTS, _BIAS))
    return mk.rounded(out.select("symbol", "open_time", "p_up"), 5)


@query("flow_udf_code", f"{mk.with_sql(mk.candles_sql())} SELECT symbol, open_time, round(coalesce(round(CASE WHEN lag(close, 3) OVER (PARTITION BY symbol ORDER BY open_time) > 0 THEN 0.5 + ln(close / lag(close, 3) OVER (PARTITION BY symbol ORDER BY open_time)) * 0.1 END, 9), 0.5), 6) + 0.0 AS p_up FROM candles")
def flow_udf_code(spark, sf_dir):
    """A flow with a user's function."""
    out = fl.chain(mk.candles(mk.trades(spark, sf_dir)), fl.pack(packs.momentum_pack), fl.code("p_up", ["ret_3"], lambda r: 0.5 + r * 0.1))
    return mk.rounded(out.select("symbol", "open_time", F.coalesce(F.nanvl("p_up", F.lit(0.5)), F.lit(0.5)).alias("p_up")))


_P = "CASE WHEN z20 IS NULL THEN 0.5 ELSE 1 / (1 + exp(-(0.1 - 0.8 * z20))) END"
_WIN = "greatest(p, 1 - p)"
_RAW = f"round(0.25 * greatest(({_WIN} - 0.55) / (1 - 0.55::DOUBLE), 0.0) * 1000.0, 2)"


@query(
    "flow_strategy",
    f"""{mk.with_sql(mk.candles_sql())}, w AS (SELECT *, count(*) OVER w20 AS n, avg(close) OVER w20 AS m, stddev_pop(close) OVER w20 AS sd FROM candles WINDOW w20 AS (PARTITION BY symbol ORDER BY open_time ROWS 19 PRECEDING)),
z AS (SELECT symbol, open_time, CASE WHEN n = 20 THEN CASE WHEN sd = 0 THEN 0.0 ELSE (close - m) / sd END END AS z20 FROM w), q AS (SELECT symbol, open_time, {_P} AS p FROM z), s AS (SELECT *, {_RAW} AS raw FROM q)
SELECT symbol, open_time, round(p, 5) + 0.0 AS p_up, CASE WHEN p >= 0.5 THEN 'UP' ELSE 'DOWN' END AS side, round(least(50.0, greatest(0.0, CASE WHEN raw < 1 OR abs(p - 0.5) * 2 < 0.2 THEN 0.0 ELSE raw END)), 0) + 0.0 AS stake FROM s""",
)
def flow_strategy(spark, sf_dir):
    """A prediction, sized by its edge, gated, and rounded to whole dollars."""
    out = fl.chain(mk.candles(mk.trades(spark, sf_dir)), fl.pack(packs.feature_pack), fl.matrix(["z20"]), fl.logistic([-0.8], 0.1), fl.edge_kelly(0.55, 1000.0), fl.gate(0.2), fl.clamp_round(high=50.0))
    return mk.rounded(out.select("symbol", "open_time", "p_up", "side", "stake"), 5)


@query(
    "flow_bands",
    f"""{mk.with_sql(mk.candles_sql())}, r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY open_time) AS g FROM candles),
q AS (SELECT symbol, open_time, close, count(g) OVER w AS n, quantile_cont(g, 0.05) OVER w AS a, quantile_cont(g, 0.5) OVER w AS b, quantile_cont(g, 0.95) OVER w AS c FROM r WINDOW w AS (PARTITION BY symbol ORDER BY open_time ROWS 59 PRECEDING))
SELECT symbol, open_time, 0.5::DOUBLE AS confidence, round(CASE WHEN n = 60 THEN close * a END, 6) + 0.0 AS p05, round(coalesce(CASE WHEN n = 60 THEN close * b END, close), 6) + 0.0 AS predicted, round(CASE WHEN n = 60 THEN close * c END, 6) + 0.0 AS p95 FROM q""",
)
def flow_bands(spark, sf_dir):
    """A prediction's outputs: the next close by the median of sixty growths (the last close until there are so many), its band, and the default confidence."""
    w = mk.series().rowsBetween(-59, 0)
    c = mk.candles(mk.trades(spark, sf_dir)).withColumn("g", F.col("close") / F.lag("close").over(mk.series()))
    band = lambda q: F.when(F.count("g").over(w) == 60, F.col("close") * F.percentile("g", q).over(w))
    out = c.select("symbol", "open_time", F.coalesce(F.lit(None).cast("double"), F.lit(0.5)).alias("confidence"), band(0.05).alias("p05"), F.coalesce(band(0.5), F.col("close")).alias("predicted"), band(0.95).alias("p95"))
    return mk.rounded(out)


_PORTS = {"inputs": {"close": "series", "volume": "scalar", "quiet": "scalar"}, "outputs": {"p_up": "scalar", "window": "series", "side": "label", "silent": "scalar"}}


def _lean(inputs, params, rng):
    """Momentum over a few bars as a probability, the last closes, a side; nothing on the silent port unless the input is quiet."""
    seen = inputs["close"][-params["bars"] :]
    lean = params["slope"] * (seen[-1] / seen[0] - 1)
    out = {"p_up": 0.5 + max(-0.4, min(0.4, lean)), "window": seen[-2:], "side": "UP" if lean > 0 else "DOWN"}
    if "quiet" in inputs:
        out["silent"] = inputs["volume"] / 3
    return out


def _quiet(c):
    return c.withColumn("quiet", F.when(F.col("trades") < 3, F.col("trades").cast("double")))


_LEAN = f"""{mk.with_sql(mk.candles_sql())}, l AS (SELECT *, list(close) OVER (PARTITION BY symbol ORDER BY open_time ROWS 4 PRECEDING) AS seen, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS k FROM candles)
SELECT symbol, open_time, round(0.5 + greatest(-0.4, least(0.4, 0.8 * (seen[-1] / seen[1] - 1))), 6) + 0.0 AS p_up, list_transform(seen[-2:], lambda x: round(x, 6)) AS "window", CASE WHEN seen[-1] / seen[1] > 1 THEN 'UP' ELSE 'DOWN' END AS side, round(CASE WHEN trades < 3 THEN volume / 3 END, 6) + 0.0 AS silent FROM l"""


def _lean_rows(df):
    return mk.rounded(df.withColumn("window", F.transform("window", lambda x: F.round(x, 6))))


@query("flow_code_node", _LEAN)
def flow_code_node(spark, sf_dir):
    """A user's function with declared ports over whole series, by a table function of SQL."""
    cn.register(spark, "lean", _lean, lookback=5)
    bars = _quiet(mk.candles(mk.trades(spark, sf_dir))).select("symbol", "open_time", *_PORTS["inputs"])
    sql = "SELECT * FROM lean(TABLE({bars}), '" + json.dumps(_PORTS).replace("{", "{{").replace("}", "}}") + """', '{{"bars": 5, "slope": 0.8}}', 7L)"""
    return _lean_rows(spark.sql(sql, bars=bars))


@query("flow_code_step", _LEAN + " WHERE k <= 3")
def flow_code_step(spark, sf_dir):
    """The same function for the last three bars of each series, each by itself."""
    bars = _quiet(mk.candles(mk.trades(spark, sf_dir)))
    last = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("open_time")))
    rows = cn.history(bars, _PORTS, 5).withColumn("k", last).filter("k <= 3")
    return _lean_rows(cn.step(rows, _lean, _PORTS, {"bars": 5, "slope": 0.8}, 7))
