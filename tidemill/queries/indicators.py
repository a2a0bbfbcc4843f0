"""Candle indicators and feature packs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.catalog import query
from tidemill.functions import indicators as ind
from tidemill.operators import packs
from tidemill.sources import market as mk

_C = mk.candles_sql()
_B = mk.bars_sql()
#: Windows that the oracles share.
_W = """WINDOW w AS (PARTITION BY symbol ORDER BY open_time), w10 AS (PARTITION BY symbol ORDER BY open_time ROWS 9 PRECEDING),
  w14 AS (PARTITION BY symbol ORDER BY open_time ROWS 13 PRECEDING), w15 AS (PARTITION BY symbol ORDER BY open_time ROWS 14 PRECEDING), wr AS (PARTITION BY symbol ORDER BY open_time ROWS 13 PRECEDING),
  w20 AS (PARTITION BY symbol ORDER BY open_time ROWS 19 PRECEDING), w60 AS (PARTITION BY symbol ORDER BY open_time ROWS 59 PRECEDING), w59 AS (PARTITION BY symbol ORDER BY open_time ROWS 58 PRECEDING)"""


def _z(c: str, w: str = "w20", n: int = 20) -> str:
    return f"CASE WHEN count({c}) OVER {w} = {n} THEN CASE WHEN stddev_pop({c}) OVER {w} = 0 THEN 0.0 ELSE ({c} - avg({c}) OVER {w}) / stddev_pop({c}) OVER {w} END END"


def _r(k: int, c: str = "close") -> str:
    return f"CASE WHEN lag({c}, {k}) OVER w > 0 THEN ln({c} / lag({c}, {k}) OVER w) END"


#: Candles with the columns that packs start from.
_BASE = f"""tr AS (SELECT *, CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM candles {_W}),
b0 AS (SELECT *, list(close) OVER w60 AS l, count(*) OVER w60 AS n, CASE WHEN count(tr) OVER w14 = 14 THEN avg(tr) OVER w14 END AS atr,
  CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 + 2 * stddev_pop(close) OVER w20 END AS bb_u,
  CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 - 2 * stddev_pop(close) OVER w20 END AS bb_l,
  {_z("close")} AS z20, {_z("volume")} AS vz, {", ".join(f"{_r(k)} AS r{k}" for k in (1, 3, 4, 5, 10, 20))} FROM tr {_W}),
base AS (SELECT *, {ind.ema_sql("l", 12)} AS ema12, {ind.ema_sql("l", 26)} AS ema26, CASE WHEN bb_u > bb_l THEN greatest(0.0, least(1.0, (close - bb_l) / (bb_u - bb_l))) END AS bp FROM b0)"""


def _sql(columns: dict[str, str], source: str = "base", more: str = _BASE, digits: int = 6, tables: str = _C, window: str = _W) -> str:
    cols = ", ".join(f"round({e}, {digits}) + 0.0 AS {n}" for n, e in columns.items())
    return f"{mk.with_sql(*[t for t in (tables, more) if t])} SELECT symbol, open_time, {cols} FROM {source} {window}"


def _candles(spark, sf_dir):
    return mk.candles(mk.trades(spark, sf_dir))


def _simple(name: str, sql: dict[str, str], build, **kw) -> None:
    """A query of indicator columns over hourly candles."""

    @query(name, _sql(sql, **kw))
    def run(spark, sf_dir):
        c = _candles(spark, sf_dir).withColumn("closes", ind.slice_of("close", mk.series()))
        return mk.rounded(c.select("symbol", "open_time", *(e.alias(n) for n, e in build(mk.series()).items())))


def _close():
    return F.col("close")


def _closes():
    return F.col("closes")


_simple("ind_sma", {"sma10": "CASE WHEN count(close) OVER w10 = 10 THEN avg(close) OVER w10 END", "sma20": "CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 END"}, lambda w: {"sma10": ind.sma(_close(), w, 10), "sma20": ind.sma(_close(), w, 20)}, source="candles", more="")
_simple("ind_ema", {"ema12": "ema12", "ema26": "ema26"}, lambda w: {"ema12": ind.ema(_closes(), 12), "ema26": ind.ema(_closes(), 26)}, window="")
_simple("ind_rsi", {"rsi14": ind.rsi_sql("l")}, lambda w: {"rsi14": ind.rsi(_closes())}, window="")
_simple("ind_boll", {"bb_u": "bb_u", "bb_l": "bb_l"}, lambda w: dict(zip(("bb_u", "bb_l"), ind.bollinger(_close(), w), strict=True)), window="")
_simple("ind_z20", {"z20": "z20", "vol_z20": "vz"}, lambda w: {"z20": ind.zscore(_close(), w), "vol_z20": ind.zscore(F.col("volume"), w)}, window="")
_simple("ind_logret", {"ret_1": "r1", "ret_20": "r20"}, lambda w: {"ret_1": ind.log_return(_close(), w, 1), "ret_20": ind.log_return(_close(), w, 20)}, window="")

_MACD = f"m AS (SELECT *, {ind.macd_series_sql('l')} AS ms FROM base), ms AS (SELECT *, {ind.ema_sql('ms', 9)} AS sig, CASE WHEN len(ms) >= 9 THEN ms[len(ms)] END AS macd FROM m)"
_simple("ind_macd", {"macd": "macd", "signal": "sig", "hist": "macd - sig"}, lambda w: {k: ind.macd(_closes())[k] for k in ("macd", "signal", "hist")}, source="ms", more=f"{_BASE},\n{_MACD}", window="")


@query("ind_atr", _sql({"atr14": "atr"}, window=""))
def ind_atr(spark, sf_dir):
    c = _candles(spark, sf_dir).withColumn("tr", ind.true_range(mk.series()))
    return mk.rounded(c.select("symbol", "open_time", ind.sma(F.col("tr"), mk.series(), 14).alias("atr14")))


@query("ind_obv", f"""{mk.with_sql(_C)}, s AS (SELECT *, coalesce(sign(close - lag(close) OVER w), 0) * volume AS f FROM candles {_W}) SELECT symbol, open_time, round(sum(f) OVER w, 6) + 0.0 AS obv FROM s {_W}""")
def ind_obv(spark, sf_dir):
    w = mk.series()
    c = _candles(spark, sf_dir).withColumn("f", F.coalesce(F.signum(_close() - F.lag("close").over(w)), F.lit(0.0)) * F.col("volume"))
    return mk.rounded(c.select("symbol", "open_time", F.sum("f").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("obv")))


def _pack(name: str, build, columns: dict[str, str], digits: int = 6, **kw) -> None:
    @query(name, _sql(columns, digits=digits, **kw))
    def run(spark, sf_dir):
        return mk.rounded(build(_candles(spark, sf_dir)), digits)


def _w26(e: str) -> str:
    return f"CASE WHEN n >= 26 THEN {e} END"


def _oa(e: str) -> str:
    return f"CASE WHEN n >= 26 AND atr > 0 THEN ({e}) / atr END"


_LAST10 = "list_sum(list_transform(list_slice(l, greatest(len(l) - 9, 1), len(l)), lambda x: x))"
_pack(
    "pack_tech",
    lambda c: packs.tech_pack(c).withColumn("last10_sum", F.aggregate("last10", F.lit(0.0), lambda a, x: a + x)).drop("last10"),
    {"sma10": "CASE WHEN count(close) OVER w10 = 10 THEN avg(close) OVER w10 END", "sma20": "CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 END", "rsi14": ind.rsi_sql("l"), "atr14": "atr",
     "trend_pct": "CASE WHEN lag(close, 19) OVER w > 0 THEN (close - lag(close, 19) OVER w) / lag(close, 19) OVER w * 100 END", "last10_sum": _LAST10},
)
_pack("pack_feature", packs.feature_pack, {"ema12": "ema12", "ema26": "ema26", "macd": "macd", "signal": "sig", "hist": "macd - sig", "bb_u": "bb_u", "bb_l": "bb_l", "logret": "coalesce(r1, 0.0)", "z20": "z20"}, source="ms", more=f"{_BASE},\n{_MACD}", window="")
_pack("pack_cross", packs.cross_pack, {"mom_x_vol": _w26("r3 * vz"), "pos_x_mom": _w26("(bp - 0.5) * r3"), "regime_x_mom": _w26("CASE WHEN atr > 0 AND close > 0 THEN atr / close * r3 END"), "trend_x_mom": f"{_oa('ema12 - ema26')} * r3", "vol_x_range": _w26("vz * (bp - 0.5)")}, window="")
_pack("pack_momentum", packs.momentum_pack, {f"ret_{k}": f"r{k}" for k in (1, 3, 5, 10, 20)}, window="")
_pack("pack_norm", packs.norm_pack, {"px_vs_ema12_atr": _oa("close - ema12"), "px_vs_ema26_atr": _oa("close - ema26"), "ema_spread_atr": _oa("ema12 - ema26"), "bb_pos": _w26("bp"), "atr_pct": _w26("CASE WHEN atr > 0 THEN atr / close END")}, window="")
_OBV = f"o0 AS (SELECT *, coalesce(sign(close - lag(close) OVER w), 0) * volume AS f FROM candles {_W}), o AS (SELECT *, sum(f) OVER w AS obv FROM o0 {_W})"
_pack(
    "pack_volume",
    packs.volume_pack,
    {"vol_z20": _z("volume"), "obv_z20": _z("obv"), "vol_vs_range": "CASE WHEN count(*) OVER w20 = 20 THEN CASE WHEN high - low > 0 THEN volume / (high - low) ELSE 0.0 END END",
     "up_vol_ratio": "CASE WHEN count(*) OVER w20 = 20 THEN CASE WHEN sum(volume) OVER w20 > 0 THEN sum(CASE WHEN close >= open THEN volume ELSE 0 END) OVER w20 / sum(volume) OVER w20 ELSE 0.5 END END"},
    digits=4, source="o", more=_OBV,
)
_H = "(hour(make_timestamp(open_time * 1000)) + minute(make_timestamp(open_time * 1000)) / 60.0)"
_D = "dayofweek(make_timestamp(open_time * 1000))"


@query(
    "pack_temporal",
    f"""{mk.with_sql(_C)} SELECT symbol, open_time, round(sin(2 * pi() * {_H} / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * {_H} / 24), 6) + 0.0 AS hour_cos, round(sin(2 * pi() * {_D} / 7), 6) + 0.0 AS dow_sin, round(cos(2 * pi() * {_D} / 7), 6) + 0.0 AS dow_cos,
  CAST({_H} >= 13 AND {_H} < 21 AS INTEGER) AS is_us_session, CAST({_H} >= 7 AND {_H} < 16 AS INTEGER) AS is_eu_session, CAST({_D} IN (0, 6) AS INTEGER) AS is_weekend FROM candles""",
)
def pack_temporal(spark, sf_dir):
    return mk.rounded(packs.temporal_pack(_candles(spark, sf_dir)))


_pack("pack_htf", lambda c: packs.htf_regime_pack(mk.resample(c, 4 * mk.HOUR)), {"htf_ema_spread_atr": _oa("ema12 - ema26"), "htf_px_vs_ema26_atr": _oa("close - ema26"), "htf_atr_pct": _w26("CASE WHEN atr > 0 THEN atr / close END"), "htf_rsi": _w26(ind.rsi_sql("l")), "htf_ret_4": _w26("r4")}, tables=mk.candles_sql(interval=4 * mk.HOUR), window="")
_SUB = f"s AS (SELECT *, {_r(1)} AS r1, {_r(5)} AS r5 FROM candles {_W})"
_pack(
    "pack_subbar",
    packs.subbar_pack,
    {"subbar_rvol": "CASE WHEN count(*) OVER w15 = 15 THEN stddev_pop(r1) OVER w14 END", "subbar_up_ratio": "CASE WHEN count(*) OVER w15 = 15 THEN (count(*) FILTER (WHERE close >= open) OVER w15) / 15.0 END",
     "subbar_vol_skew": "CASE WHEN count(*) OVER w15 = 15 THEN CASE WHEN sum(volume) OVER w15 > 0 THEN sum(CASE WHEN close >= open THEN volume ELSE -volume END) OVER w15 / sum(volume) OVER w15 ELSE 0.0 END END",
     "subbar_ret_5": "CASE WHEN count(*) OVER w15 = 15 THEN r5 END"},
    source="s", more=_SUB,
)


def _bars(spark, sf_dir):
    return mk.bars(mk.trades(spark, sf_dir))


_OF = "s AS (SELECT *, buy_volume - sell_volume AS sv, CAST(trade_count AS DOUBLE) AS tc FROM bars)"


@query(
    "pack_orderflow",
    _sql(
        {"of_imbalance": "CASE WHEN count(*) OVER w20 = 20 AND buy_volume + sell_volume > 0 THEN sv / (buy_volume + sell_volume) END", "of_count_imbalance": "CASE WHEN count(*) OVER w20 = 20 AND trade_count > 0 THEN (2 * buy_trade_count - trade_count) / tc END",
         "of_large_skew": "CASE WHEN count(*) OVER w20 = 20 AND large_buy_volume + large_sell_volume > 0 THEN (large_buy_volume - large_sell_volume) / (large_buy_volume + large_sell_volume) END", "of_cvd_z": _z("sv"), "of_intensity_z": _z("tc")},
        source="s", more=_OF, tables=_B,
    ),
)
def pack_orderflow(spark, sf_dir):
    return mk.rounded(packs.orderflow_pack(_bars(spark, sf_dir)))


_LATE, _EARLY = "CASE WHEN lb + ls > 0 THEN (lb - ls) / (lb + ls) END", "CASE WHEN eb + es > 0 THEN (eb - es) / (eb + es) END"


@query(
    "pack_microflow",
    _sql({"mf_late_imbalance": _LATE, "mf_imbalance_accel": f"{_LATE} - {_EARLY}", "mf_late_intensity": "late_trade_count / (0.2 * trade_count) - 1"}, source="s", more="s AS (SELECT *, late_buy_volume lb, late_sell_volume ls, early_buy_volume eb, early_sell_volume es FROM bars)", tables=_B, window=""),
)
def pack_microflow(spark, sf_dir):
    return mk.rounded(packs.microflow_pack(_bars(spark, sf_dir)))


#: Stand-ins for derivatives metrics, absent in some bars.
_METRICS = "CASE WHEN trade_count % 7 <> 0 THEN 1000 + buy_volume * 3 + trade_count END AS open_interest, 0.5 + buy_trade_count / 3.0 AS top_ls, (buy_volume + 1) / (sell_volume + 1) AS taker_ls, 1.0 + trade_count / 10.0 AS ls_ratio"
_DERIV = f"""q0 AS (SELECT *, {_METRICS} FROM bars), q1 AS (SELECT *, {_r(1, "open_interest")} AS d, lag(open_interest, 3) OVER w AS oi4 FROM q0 {_W}),
q AS (SELECT *, list(d) FILTER (WHERE d IS NOT NULL) OVER w59 AS ds FROM q1 {_W}), p AS (SELECT *, list_slice(ds, greatest(len(ds) - 19, 1), len(ds)) AS t FROM q)"""


@query(
    "pack_derivatives",
    _sql(
        {"d_oi_mom": "CASE WHEN count(*) OVER w20 = 20 AND oi4 > 0 AND open_interest > 0 THEN ln(open_interest / oi4) END", "d_oi_z": "CASE WHEN count(*) OVER w20 = 20 AND len(ds) >= 20 THEN CASE WHEN list_stddev_pop(t) = 0 THEN 0.0 ELSE (t[len(t)] - list_avg(t)) / list_stddev_pop(t) END END",
         "d_toptrader_ls": "CASE WHEN count(*) OVER w20 = 20 THEN ln(top_ls) END", "d_taker_ls": "CASE WHEN count(*) OVER w20 = 20 THEN ln(taker_ls) END", "d_ls_ratio": "CASE WHEN count(*) OVER w20 = 20 THEN ln(ls_ratio) END"},
        source="p", more=_DERIV, tables=_B,
    ),
)
def pack_derivatives(spark, sf_dir):
    b = _bars(spark, sf_dir)
    n, buy, sell = (F.col(c) for c in ("trade_count", "buy_volume", "sell_volume"))
    b = b.withColumns({"open_interest": F.when(n % 7 != 0, 1000 + buy * 3 + n), "top_ls": 0.5 + F.col("buy_trade_count") / 3.0, "taker_ls": (buy + 1) / (sell + 1), "ls_ratio": 1.0 + n / 10.0})
    return mk.rounded(packs.derivatives_pack(b))
