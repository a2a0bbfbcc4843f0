"""Time joins: as-of, nearest, and ranked fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str], block: int) -> DataFrame:
    """left with ``values`` of the latest right row of equal keys and right_time <= left_time (NULL if none).

    Both sides meet in blocks of ``block`` time units of a key, so a busy key
    spreads over many tasks; what a block inherits is the last value of the
    blocks before it, found on one row a block. Of right rows with equal times
    the greatest by values counts.
    """
    pack = F.struct(F.col(right_time).alias("_at"), *values)
    ls = left.withColumns({"_t": F.col(left_time), "_side": F.lit(1), "_v": F.lit(None).cast(right.select(pack.alias("v")).schema["v"].dataType), "_row": F.struct(*left.columns)}).select(*on, "_t", "_side", "_v", "_row")
    rs = right.select(*on, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), pack.alias("_v"), F.lit(None).cast(ls.schema["_row"].dataType).alias("_row"))
    both = ls.union(rs).withColumn("_block", F.floor(F.col("_t") / block))
    inside = Window.partitionBy(*on, "_block").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_own", F.last("_v", ignorenulls=True).over(inside)).filter("_side = 1")
    ends = both.groupBy(*on, "_block").agg(F.max("_v").alias("_end"))
    before = Window.partitionBy(*on).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*on, "_block", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    out = met.join(carried, [*on, "_block"], "left").withColumn("_v", F.coalesce("_own", "_carried"))
    return out.select("_row.*", *(F.col(f"_v.{c}").alias(c) for c in values))


def close_time_asof(decisions: DataFrame, higher: DataFrame, interval: int, higher_interval: int, values: list[str], horizon: int = 2) -> DataFrame:
    """Decisions (symbol, anchor_open) with the latest higher-timeframe candle that is closed for them.

    A candle counts if its open is at most min(target - 1, boundary) less its
    own interval, where boundary is the anchor's close and target the open
    ``horizon`` candles on; at horizon 1 a candle that closes exactly then is out.
    """
    boundary = F.col("anchor_open") + interval
    limit = F.least(F.col("anchor_open") + horizon * interval - 1, boundary) - higher_interval
    right = higher.withColumnRenamed("open_time", "htf_open")
    return asof(decisions.withColumn("_limit", limit), right, ["symbol"], "_limit", "htf_open", ["htf_open", *values], block=64 * higher_interval).drop("_limit")


def top1(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def unique_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, failing when read if ``keys`` repeat: the check of a one-to-one merge."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).filter(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"repeated key {keys}")).cast("boolean")).otherwise(True)).drop("_n")
