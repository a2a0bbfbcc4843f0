"""Rolling features over (symbol, open_time) series. Trailing frames count rows and yield NULL until full."""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.sources.market import series

KEYS = ("symbol", "open_time")


def last(n: int):
    return series().rowsBetween(-(n - 1), 0)


def full(c: str | Column, n: int, value: Column) -> Column:
    return F.when(F.count(c).over(last(n)) == n, value)


def rolling(df: DataFrame, c: str, sizes: Iterable[int]) -> DataFrame:
    funcs = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum, "min": F.min, "max": F.max}
    return df.select(*KEYS, *(full(c, n, f(c).over(last(n))).alias(f"{k}_{n}") for n in sizes for k, f in funcs.items()))


def sample_z(c: Column, n: int, eps: float = 1e-12) -> Column:
    """Z-score by the sample deviation, kept from zero by eps."""
    return full(c, n, (c - F.avg(c).over(last(n))) / (F.stddev_samp(c).over(last(n)) + eps))


def run_length(df: DataFrame) -> DataFrame:
    """Signed length of the current run of returns of one sign."""
    w = series()
    df = df.withColumn("sg", F.coalesce(F.signum("r"), F.lit(0.0)))
    df = df.withColumn("ch", F.when(F.col("sg").eqNullSafe(F.lag("sg").over(w)), 0).otherwise(1))
    df = df.withColumn("island", F.sum("ch").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.row_number().over(Window.partitionBy("symbol", "island").orderBy("open_time"))
    return df.select(*KEYS, (n * F.col("sg").cast("long")).alias("i_run"))


def percent_rank(c: str, n: int) -> Column:
    """Average-tie percentile rank of the last value among n rows (fewer at the start)."""
    a = F.collect_list(c).over(last(n))
    less, same = F.size(F.filter(a, lambda x: x < F.col(c))), F.size(F.filter(a, lambda x: x == F.col(c)))
    return (less.cast("double") + (same.cast("double") + 1) / 2) / F.size(a)


def corr_beta(df: DataFrame, n: int = 48) -> DataFrame:
    """Of returns and changes in log volume."""
    df = df.withColumn("dv", F.ln((F.col("volume") + 1) / (F.lag("volume").over(series()) + 1)))
    cov, var = F.covar_samp("r", "dv").over(last(n)), F.var_samp("dv").over(last(n))
    return df.select(*KEYS, full("r", n, F.corr("r", "dv").over(last(n))).alias("corr"), full("r", n, cov).alias("cov"), full("r", n, F.when(var != 0, cov / var)).alias("beta"))


def roll_spread(df: DataFrame, n: int = 48) -> DataFrame:
    df = df.withColumn("rl", F.lag("r").over(series()))
    return df.select(*KEYS, full("rl", n, 2 * F.sqrt(F.greatest(-F.covar_samp("r", "rl").over(last(n)), F.lit(0.0)))).alias("roll"))


def efficiency(df: DataFrame, n: int = 12) -> DataFrame:
    df = df.withColumn("d", F.abs(F.col("close") - F.lag("close").over(series())))
    path = F.sum("d").over(last(n))
    return df.select(*KEYS, full("d", n, F.when(path != 0, F.abs(F.col("close") - F.lag("close", n).over(series())) / path)).alias("er12"))


def vwap_deviation(df: DataFrame, n: int = 12) -> DataFrame:
    volume = F.sum("volume").over(last(n))
    vwap = F.when(volume != 0, F.sum(F.col("close") * F.col("volume")).over(last(n)) / volume)
    return df.select(*KEYS, full(F.lit(1), n, F.when(vwap != 0, F.col("close") / vwap - 1)).alias("vwap_dev"))


def garman_klass(df: DataFrame, n: int = 12) -> DataFrame:
    hl, co = F.ln(F.col("high") / F.col("low")), F.ln(F.col("close") / F.col("open"))
    df = df.withColumn("gk", 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co)
    return df.select(*KEYS, full("gk", n, F.sqrt(F.greatest(F.avg("gk").over(last(n)), F.lit(0.0)))).alias("rv_gk"))


def vol_of_vol(df: DataFrame, n: int = 12, m: int = 48) -> DataFrame:
    df = df.withColumn("sd", full("r", n, F.stddev_samp("r").over(last(n))))
    return df.select(*KEYS, full("sd", m, F.stddev_samp("sd").over(last(m))).alias("vov"))


def drawdown(df: DataFrame, c: str = "close") -> DataFrame:
    peak = F.max(c).over(series().rowsBetween(Window.unboundedPreceding, 0))
    return df.select(*KEYS, peak.alias("peak"), (peak - F.col(c)).alias("drawdown"))


def recent_max(df: DataFrame, n: int = 6) -> DataFrame:
    high = F.max(F.abs("r")).over(last(n))
    return df.select(*KEYS, high.alias("recent_max"), (F.abs("r") < high).cast("double").alias("decel"))


def signed_flow(df: DataFrame, n: int = 6) -> DataFrame:
    df = df.withColumn("f", F.signum("r") * F.col("volume"))
    return df.select(*KEYS, full("f", n, F.avg("f").over(last(n))).alias("flow"))


def candle_shape(df: DataFrame) -> DataFrame:
    """Body and wicks as shares of the range; NULL for a candle without range."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    share = lambda x: F.when(h != l, x / (h - l))
    return df.select(*KEYS, share(c - o).alias("body_range"), share(h - F.greatest(o, c)).alias("wick_up"), share(F.least(o, c) - l).alias("wick_dn"))


def funding_cycle(df: DataFrame, cycle: int = 8 * 3_600_000) -> DataFrame:
    at = F.pmod("open_time", F.lit(cycle))
    angle = 2 * math.pi * at / cycle
    return df.select(*KEYS, ((cycle - at) / 60_000).cast("double").alias("mins"), F.sin(angle).alias("cyc_sin"), F.cos(angle).alias("cyc_cos"))


#: Bars of a block of the sums without end, and the bar width that blocks are counted in.
BLOCK, WIDTH = 64, 3_600_000


def decayed(df: DataFrame, columns: list[str], alpha: float, width: int = WIDTH) -> DataFrame:
    """df with, for each column c, sum_c, the sum of all values so far, each less by 1 - alpha a row, and first_c, the first value; and n, the rows before.

    A series is cut into blocks of time, and these, where bars are finer than
    ``width``, into BLOCK rows each, so that no power leaves the range of doubles.
    Rows are summed within their block, and what a block inherits is carried over
    one row a block, so a long series spreads over many tasks and only its block
    ends meet in one.
    """
    keep, whole = 1 - alpha, Window.partitionBy("symbol", "_time").orderBy("open_time")
    own = df.withColumn("_time", F.floor(F.col("open_time") / (BLOCK * width))).withColumn("_at", F.row_number().over(whole) - 1)
    own = own.withColumn("_block", F.struct("_time", F.floor(F.col("_at") / BLOCK).alias("part"))).withColumn("_i", F.pmod("_at", F.lit(BLOCK)))
    so_far = Window.partitionBy("symbol", "_time", "_block").orderBy("open_time").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumns({f"_own_{c}": F.pow(F.lit(keep), F.col("_i")) * F.sum(F.col(c) * F.pow(F.lit(1 / keep), F.col("_i"))).over(so_far) for c in columns})
    ends = own.groupBy("symbol", "_block").agg(F.count("*").alias("_n"), *(F.max_by(f"_own_{c}", "_i").alias(f"_end_{c}") for c in columns), *(F.min_by(c, "_i").alias(f"_head_{c}") for c in columns))

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_time", "_part"])
        out = pdf[["symbol", "_time", "_part"]].copy()
        out["_before"] = pdf["_n"].cumsum() - pdf["_n"]
        for c in columns:
            held, sums = 0.0, []
            for n, end in zip(pdf["_n"], pdf[f"_end_{c}"], strict=True):
                sums.append(held)
                held = end + keep**n * held
            out[f"_carry_{c}"], out[f"first_{c}"] = sums, pdf[f"_head_{c}"].iloc[0]
        return out

    ends = ends.select("symbol", F.col("_block._time").alias("_time"), F.col("_block.part").alias("_part"), *(c for c in ends.columns if c not in ("symbol", "_block")))
    carried = ends.groupBy("symbol").applyInPandas(carry, "symbol string, _time long, _part long, _before long, " + ", ".join(f"_carry_{c} double, first_{c} double" for c in columns))
    carried = carried.withColumn("_block", F.struct("_time", F.col("_part").alias("part"))).drop("_time", "_part")
    out = own.join(carried, ["symbol", "_block"])
    sums = {f"sum_{c}": F.col(f"_own_{c}") + F.pow(F.lit(keep), F.col("_i") + 1) * F.col(f"_carry_{c}") for c in columns}
    return out.withColumns({**sums, "n": F.col("_before") + F.col("_i")}).select(*df.columns, "n", *sums, *(f"first_{c}" for c in columns))


def recursive(c: str, alpha: float) -> Column:
    """The mean e = alpha x + (1 - alpha) e, begun with the first value, from the columns of ``decayed``."""
    return alpha * F.col(f"sum_{c}") + F.pow(F.lit(1 - alpha), F.col("n") + 1) * F.col(f"first_{c}")


def ewm(df: DataFrame, c: str, alpha: float) -> DataFrame:
    """Exponentially weighted means without end: weights normalised (ewm_adj) and recursive (ewm_rec)."""
    weights = (1 - F.pow(F.lit(1 - alpha), F.col("n") + 1)) / alpha
    return decayed(df.select(*KEYS, c), [c], alpha).select(*KEYS, (F.col(f"sum_{c}") / weights).alias("ewm_adj"), recursive(c, alpha).alias("ewm_rec"))


def ewm_std(df: DataFrame, c: str, alpha: float) -> DataFrame:
    """Sample deviation by normalised exponential weights; NULL for the first row. Values count from the series' first one, so that large levels cost no digits."""
    keep, rows = 1 - alpha, F.col("n") + 1
    first = df.groupBy("symbol").agg(F.min_by(c, "open_time").alias("_first"))
    own = df.select(*KEYS, c).join(first, "symbol").select(*KEYS, (F.col(c) - F.col("_first")).alias("off")).withColumn("square", F.col("off") * F.col("off"))
    s = decayed(own, ["off", "square"], alpha)
    w, w2 = (1 - F.pow(F.lit(keep), rows)) / alpha, (1 - F.pow(F.lit(keep * keep), rows)) / (1 - keep * keep)
    mean = F.col("sum_off") / w
    var = F.greatest(F.col("sum_square") / w - mean * mean, F.lit(0.0)) * w * w / (w * w - w2)
    return s.select(*KEYS, F.when(F.col("n") > 0, F.sqrt(var)).alias("ewm_std"))


def adx(df: DataFrame, n: int = 14) -> DataFrame:
    """ADX from 0 to 1 and DMI from -1 to 1 by Wilder's smoothing; NULL until there are n rows, ADX n - 1 later."""
    w, tiny = series(), 1e-12
    before, high, low = F.lag("close").over(w), F.col("high"), F.col("low")
    up, down = high - F.lag("high").over(w), F.lag("low").over(w) - low
    moves = df.select(
        *KEYS, F.greatest(high - low, F.abs(high - before), F.abs(low - before)).alias("tr"),
        F.when((up > down) & (up > 0), up).otherwise(0.0).alias("plus"), F.when((down > up) & (down > 0), down).otherwise(0.0).alias("minus"),
    )
    s = decayed(moves, ["tr", "plus", "minus"], 1 / n)
    s = s.select(*KEYS, "n", *(recursive(c, 1 / n).alias(c) for c in ("tr", "plus", "minus"))).filter(F.col("n") >= n - 1)
    s = s.withColumns({"p": 100 * F.col("plus") / (F.col("tr") + tiny), "m": 100 * F.col("minus") / (F.col("tr") + tiny)})
    s = s.select(*KEYS, ((F.col("p") - F.col("m")) / (F.col("p") + F.col("m") + tiny)).alias("dmi"), (100 * F.abs(F.col("p") - F.col("m")) / (F.col("p") + F.col("m") + tiny)).alias("dx"))
    smooth = decayed(s, ["dx"], 1 / n)
    return smooth.select(*KEYS, F.when(F.col("n") >= n - 1, recursive("dx", 1 / n) / 100).alias("adx"), "dmi")
