"""Feature packs: candles or bars in, named scalars out, one row a candle, NULL in warm-up.

All packs of one series share one window specification, so Spark sorts it once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import indicators as ind
from tidemill.sources.market import series

KEYS = ("symbol", "open_time")


def _kept(df: DataFrame, carry: bool) -> tuple[str, ...]:
    """What a pack passes on beside its outputs: the keys, or with ``carry`` all that came in."""
    return tuple(df.columns) if carry else KEYS


def _base(candles: DataFrame, limit: int) -> DataFrame:
    """Candles with what several packs use."""
    w = series()
    df = candles.withColumn("tr", ind.true_range(w)).withColumn("closes", ind.slice_of("close", w, limit))
    df = df.withColumn("rows", F.count("*").over(ind.trailing(w, limit))).withColumn("atr", ind.sma(F.col("tr"), w, 14))
    upper, lower = ind.bollinger(F.col("close"), w)
    df = df.withColumns({"bb_u": upper, "bb_l": lower, "ema12": ind.ema(F.col("closes"), 12), "ema26": ind.ema(F.col("closes"), 26)})
    position = (F.col("close") - F.col("bb_l")) / (F.col("bb_u") - F.col("bb_l"))
    return df.withColumn("bb_position", F.when(F.col("bb_u") > F.col("bb_l"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), position))))


def _ret(k: int) -> Column:
    return ind.log_return(F.col("close"), series(), k)


def _warm(n: int, c: Column) -> Column:
    return F.when(F.col("rows") >= n, c)


def _over_atr(c: Column) -> Column:
    return F.when(F.col("atr") > 0, c / F.col("atr"))


def tech_pack(candles: DataFrame, limit: int = ind.LIMIT, carry: bool = False) -> DataFrame:
    w = series()
    before = F.lag("close", 19).over(w)
    return _base(candles, limit).select(
        *_kept(candles, carry), ind.sma(F.col("close"), w, 10).alias("sma10"), ind.sma(F.col("close"), w, 20).alias("sma20"), ind.rsi(F.col("closes")).alias("rsi14"), F.col("atr").alias("atr14"),
        F.when(before > 0, (F.col("close") - before) / before * 100).alias("trend_pct"), ind.slice_of("close", w, 10).alias("last10"),
    )


def feature_pack(candles: DataFrame, limit: int = ind.LIMIT, carry: bool = False) -> DataFrame:
    m = ind.macd(F.col("closes"))
    return _base(candles, limit).withColumn("m", m).select(
        *_kept(candles, carry), "ema12", "ema26", F.col("m.macd").alias("macd"), F.col("m.signal").alias("signal"), F.col("m.hist").alias("hist"), "bb_u", "bb_l",
        F.coalesce(_ret(1), F.lit(0.0)).alias("logret"), ind.zscore(F.col("close"), series()).alias("z20"),
    )


def cross_pack(candles: DataFrame, limit: int = ind.LIMIT, carry: bool = False) -> DataFrame:
    w = series()
    df = _base(candles, limit).withColumns({"ret_3": _ret(3), "vol_z": ind.zscore(F.col("volume"), w)})
    ret, mid = F.col("ret_3"), F.col("bb_position") - 0.5
    return df.select(
        *_kept(candles, carry), _warm(26, ret * F.col("vol_z")).alias("mom_x_vol"), _warm(26, mid * ret).alias("pos_x_mom"), _warm(26, F.when((F.col("atr") > 0) & (F.col("close") > 0), F.col("atr") / F.col("close") * ret)).alias("regime_x_mom"),
        _warm(26, _over_atr(F.col("ema12") - F.col("ema26")) * ret).alias("trend_x_mom"), _warm(26, F.col("vol_z") * mid).alias("vol_x_range"),
    )


def momentum_pack(candles: DataFrame, carry: bool = False) -> DataFrame:
    return candles.select(*_kept(candles, carry), *(_ret(k).alias(f"ret_{k}") for k in (1, 3, 5, 10, 20)))


def norm_pack(candles: DataFrame, limit: int = ind.LIMIT, carry: bool = False) -> DataFrame:
    return _base(candles, limit).select(
        *_kept(candles, carry), _warm(26, _over_atr(F.col("close") - F.col("ema12"))).alias("px_vs_ema12_atr"), _warm(26, _over_atr(F.col("close") - F.col("ema26"))).alias("px_vs_ema26_atr"),
        _warm(26, _over_atr(F.col("ema12") - F.col("ema26"))).alias("ema_spread_atr"), _warm(26, F.col("bb_position")).alias("bb_pos"), _warm(26, F.when(F.col("atr") > 0, F.col("atr") / F.col("close"))).alias("atr_pct"),
    )


def volume_pack(candles: DataFrame, carry: bool = False) -> DataFrame:
    w = series()
    last = ind.trailing(w, 20)
    obv = F.sum(F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)), F.lit(0.0)) * F.col("volume")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = candles.withColumns({"rows": F.count("*").over(last), "flow": F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)), F.lit(0.0)) * F.col("volume")})
    df = df.withColumn("obv", obv)
    up = F.sum(F.when(F.col("close") >= F.col("open"), F.col("volume")).otherwise(0.0)).over(last)
    total = F.sum("volume").over(last)
    span = F.col("high") - F.col("low")
    return df.select(
        *_kept(candles, carry), ind.zscore(F.col("volume"), w).alias("vol_z20"), ind.zscore(F.col("obv"), w).alias("obv_z20"),
        _warm(20, F.when(span > 0, F.col("volume") / span).otherwise(0.0)).alias("vol_vs_range"), _warm(20, F.when(total > 0, up / total).otherwise(0.5)).alias("up_vol_ratio"),
    )


def temporal_pack(candles: DataFrame, target: Column | None = None, carry: bool = False) -> DataFrame:
    """Of the target candle's open; days count from Sunday."""
    at = F.timestamp_millis(F.col("open_time") if target is None else target)
    hour, day = F.hour(at) + F.minute(at) / 60.0, F.dayofweek(at) - 1
    flag = lambda c: F.when(c, 1).otherwise(0).cast("int")
    return candles.select(
        *_kept(candles, carry), F.sin(2 * math.pi * hour / 24).alias("hour_sin"), F.cos(2 * math.pi * hour / 24).alias("hour_cos"), F.sin(2 * math.pi * day / 7).alias("dow_sin"), F.cos(2 * math.pi * day / 7).alias("dow_cos"),
        flag((F.hour(at) >= 13) & (F.hour(at) < 21)).alias("is_us_session"), flag((F.hour(at) >= 7) & (F.hour(at) < 16)).alias("is_eu_session"), flag(day.isin(0, 6)).alias("is_weekend"),
    )


def htf_regime_pack(candles: DataFrame, limit: int = ind.LIMIT, carry: bool = False) -> DataFrame:
    """On the higher timeframe's own candles; join to decisions by close time."""
    return _base(candles, limit).select(
        *_kept(candles, carry), _warm(26, _over_atr(F.col("ema12") - F.col("ema26"))).alias("htf_ema_spread_atr"), _warm(26, _over_atr(F.col("close") - F.col("ema26"))).alias("htf_px_vs_ema26_atr"),
        _warm(26, F.when(F.col("atr") > 0, F.col("atr") / F.col("close"))).alias("htf_atr_pct"), _warm(26, ind.rsi(F.col("closes"))).alias("htf_rsi"), _warm(26, _ret(4)).alias("htf_ret_4"),
    )


def subbar_pack(candles: DataFrame, window: int = 15, carry: bool = False) -> DataFrame:
    """On the lower timeframe's candles."""
    window = max(5, window)
    w = series()
    last = ind.trailing(w, window)
    up = F.col("close") >= F.col("open")
    df = candles.withColumns({"rows": F.count("*").over(last), "r": _ret(1)})
    total = F.sum("volume").over(last)
    gain = F.sum(F.when(up, F.col("volume")).otherwise(-F.col("volume"))).over(last)
    return df.select(
        *_kept(candles, carry), _warm(window, F.stddev_pop("r").over(w.rowsBetween(-(window - 2), 0))).alias("subbar_rvol"), _warm(window, F.count_if(up).over(last) / window).alias("subbar_up_ratio"),
        _warm(window, F.when(total > 0, gain / total).otherwise(0.0)).alias("subbar_vol_skew"), _warm(window, _ret(5)).alias("subbar_ret_5"),
    )


def orderflow_pack(bars: DataFrame, carry: bool = False) -> DataFrame:
    w = series()
    df = bars.withColumns({"rows": F.count("*").over(ind.trailing(w, 20)), "signed": F.col("buy_volume") - F.col("sell_volume")})
    total, large = F.col("buy_volume") + F.col("sell_volume"), F.col("large_buy_volume") + F.col("large_sell_volume")
    return df.select(
        *_kept(bars, carry), _warm(20, F.when(total > 0, F.col("signed") / total)).alias("of_imbalance"),
        _warm(20, F.when(F.col("trade_count") > 0, (2 * F.col("buy_trade_count") - F.col("trade_count")) / F.col("trade_count"))).alias("of_count_imbalance"),
        _warm(20, F.when(large > 0, (F.col("large_buy_volume") - F.col("large_sell_volume")) / large)).alias("of_large_skew"),
        ind.zscore(F.col("signed"), w).alias("of_cvd_z"), ind.zscore(F.col("trade_count").cast("double"), w).alias("of_intensity_z"),
    )


def microflow_pack(bars: DataFrame, carry: bool = False) -> DataFrame:
    """NULL where a bar lacks any of its late and early columns."""
    lb, ls, eb, es = (F.col(c) for c in ("late_buy_volume", "late_sell_volume", "early_buy_volume", "early_sell_volume"))
    whole = F.col("late_trade_count").isNotNull()
    for c in (lb, ls, eb, es):
        whole = whole & c.isNotNull()
    late, early = F.when(whole & (lb + ls > 0), (lb - ls) / (lb + ls)), F.when(whole & (eb + es > 0), (eb - es) / (eb + es))
    return bars.select(*_kept(bars, carry), late.alias("mf_late_imbalance"), (late - early).alias("mf_imbalance_accel"), F.when(whole & (F.col("trade_count") > 0), F.col("late_trade_count") / (0.2 * F.col("trade_count")) - 1).alias("mf_late_intensity"))


def derivatives_pack(bars: DataFrame, limit: int = ind.LIMIT, carry: bool = False) -> DataFrame:
    """From open_interest, top_ls, taker_ls and ls_ratio; changes between valid neighbours only enter the z-score."""
    w = series()
    oi, before = F.col("open_interest"), F.lag("open_interest").over(w)
    df = bars.withColumns({"rows": F.count("*").over(ind.trailing(w, 20)), "d": F.when((oi > 0) & (before > 0), F.ln(oi / before)), "oi_4": F.lag("open_interest", 3).over(w)})
    df = df.withColumn("ds", F.collect_list("d").over(w.rowsBetween(-(limit - 2), 0)))
    tail = F.slice(F.col("ds"), F.greatest(F.size("ds") - 19, F.lit(1)), F.lit(20))
    df = df.withColumn("tail", tail)
    mean = F.aggregate("tail", F.lit(0.0), lambda a, x: a + x) / 20
    df = df.withColumn("mean", mean)
    std = F.sqrt(F.aggregate("tail", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / 20)
    df = df.withColumn("std", std)
    z = F.when(F.size("ds") >= 20, F.when(F.col("std") == 0, F.lit(0.0)).otherwise((F.element_at("tail", -1) - F.col("mean")) / F.col("std")))
    positive = lambda c: F.when(F.col(c) > 0, F.ln(c))
    return df.select(
        *_kept(bars, carry), _warm(20, F.when((F.col("oi_4") > 0) & (oi > 0), F.ln(oi / F.col("oi_4")))).alias("d_oi_mom"), _warm(20, z).alias("d_oi_z"),
        _warm(20, positive("top_ls")).alias("d_toptrader_ls"), _warm(20, positive("taker_ls")).alias("d_taker_ls"), _warm(20, positive("ls_ratio")).alias("d_ls_ratio"),
    )
