"""Balances of runs of bets on credit, and what is told of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Money is summed exactly.
MONEY = "decimal(28,6)"


def equity(bets: DataFrame, keys: list[str], order: str, stake: Column, price: float, bank: float) -> DataFrame:
    """Add stake, before, after, shortfall (what of the stake the balance lacks), crossed and fall (below the highest balance so far, the bank included) to bets with ``won``.

    A bet crosses zero if it is placed short or leaves a balance of another sign.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    b = bets.withColumn("stake", stake.cast(MONEY))
    gain = F.when(F.col("won"), (F.col("stake").cast("double") * (1 - price) / price)).otherwise(-F.col("stake").cast("double"))
    b = b.withColumn("after", (F.lit(bank).cast(MONEY) + F.sum(F.round(gain, 6).cast(MONEY)).over(upto)).cast(MONEY))
    b = b.withColumn("before", F.coalesce(F.lag("after").over(w), F.lit(bank).cast(MONEY)))
    short = F.greatest(F.col("stake") - F.greatest(F.col("before"), F.lit(0).cast(MONEY)), F.lit(0).cast(MONEY))
    top = F.greatest(F.lit(bank).cast(MONEY), F.max("after").over(upto))
    b = b.withColumn("shortfall", short).withColumn("fall", top - F.col("after"))
    return b.withColumn("crossed", (F.col("shortfall") > 0) | (F.signum(F.col("before").cast("double")) != F.signum(F.col("after").cast("double"))))


def stats(runs: DataFrame, keys: list[str], order: str, bank: float) -> DataFrame:
    """A row a run of ``equity``: bets, final, peak, trough, worst fall, the most borrowed (short of a stake or below zero), crossings."""
    number = lambda c: c.cast("double")
    return runs.groupBy(*keys).agg(
        F.count("*").alias("bets"), number(F.max_by("after", order)).alias("final"), number(F.greatest(F.max("after"), F.lit(bank).cast(MONEY))).alias("peak"), number(F.least(F.min("after"), F.lit(bank).cast(MONEY))).alias("trough"),
        number(F.max("fall")).alias("max_drawdown"), number(F.greatest(F.max("shortfall"), -F.min("after"), F.lit(0).cast(MONEY))).alias("peak_borrowed"), F.count_if("crossed").alias("crossings"),
    )


def windows(samples: DataFrame, combos: DataFrame, keys: list[str], bank: float) -> DataFrame:
    """Samples (keys, final, survived, max_drawdown, crossings) by combo: bust rate, percentiles and mean of profit, worst fall, mean crossings, and whether it passes: no bust and a median above 0. A combo without samples is bust throughout and else all zero."""
    profit = F.col("final") - bank
    g = samples.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg((~F.col("survived")).cast("double")).alias("bust_rate"), *(F.percentile(profit, q).alias(f"p{round(q * 100)}") for q in (0.05, 0.5, 0.95)),
        F.avg(profit).alias("mean_profit"), F.max("max_drawdown").alias("worst_drawdown"), F.avg("crossings").alias("mean_crossings"),
    )
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("p5", "p50", "p95", "mean_profit", "worst_drawdown", "mean_crossings")]
    out = combos.join(g, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bust_rate", F.lit(1.0)).alias("bust_rate"), *zero)
    return out.withColumn("passes", (F.col("bust_rate") == 0) & (F.col("p50") > 0))
