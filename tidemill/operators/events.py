"""Gate of forced-flow events: bets count only where one of five mechanisms is active."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.rolling import last, sample_z
from tidemill.sources.market import HOUR, series

#: Limits of the mechanisms (fixed values): deviations of a dislocation and of a move before funding; hours of the cash session.
FAR, BEFORE_FUNDING, SESSION = 2.0, 1.5, (14, 20)
MECHANISMS = ("cascade", "flush", "premium", "prefunding", "cross")


def mechanisms(df: DataFrame) -> DataFrame:
    """df (candles with the log return r) with a boolean for each mechanism, never NULL.

    cascade: three returns of one sign, or a move under half the greatest of six;
    flush: volume far over its day while the price falls; premium: the close far
    from its mean of twelve, by 96 bars; prefunding: a large move in the hour
    before the eight-hourly funding; cross: the close far from that of all series
    at the time, in the cash session.
    """
    w, r = series(), F.col("r")
    together = df.groupBy("open_time").agg(F.avg("close").alias("_all"))  # a row a time
    df = df.join(together, "open_time").withColumns({"_dev": F.col("close") / F.avg("close").over(last(12)) - 1, "_gap": F.col("close") / F.col("_all") - 1})
    same = (F.signum(r) != 0) & (F.signum(r) == F.signum(F.lag("r").over(w))) & (F.signum(r) == F.signum(F.lag("r", 2).over(w)))
    hour = F.pmod(F.floor(F.col("open_time") / HOUR), F.lit(24))
    found: dict[str, Column] = {
        "cascade": same | (F.abs("r") < 0.5 * F.max(F.abs("r")).over(last(6))),
        "flush": (sample_z(F.col("volume"), 24) > FAR) & (r < 0),
        "premium": F.abs(sample_z(F.col("_dev"), 96)) > FAR,
        "prefunding": (F.pmod("open_time", F.lit(8 * HOUR)) >= 7 * HOUR) & (F.abs(sample_z(r, 24)) > BEFORE_FUNDING),
        "cross": (F.abs(sample_z(F.col("_gap"), 24)) > FAR) & hour.between(*SESSION),
    }
    return df.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in found.items()}).drop("_all", "_dev", "_gap")


def gated(p: Column) -> Column:
    """The confidence of p where any mechanism is active, -1 elsewhere, so that nothing else is ever selected before it."""
    active = F.col(MECHANISMS[0])
    for m in MECHANISMS[1:]:
        active = active | F.col(m)
    return F.when(active, F.abs(p - 0.5)).otherwise(-1.0)
