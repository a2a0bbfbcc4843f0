"""A frozen harness: a dataset that must not change, and one plan that fits, calibrates and judges a model over pinned windows.

Raw scores are rounded to four digits, so a window has at most 10,001 of them:
its isotonic curve and its thresholds stay that small however many rows it has.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import stats as st
from tidemill.plans import models as mo

#: Fixed values of the harness: shares of the surest rows, share of the training rows that calibrate, fee at even odds, weight of the raw score in ties.
COVERAGES = (0.1, 0.05, 0.025, 0.01, 0.005)
CALIBRATION, FEE, TIES = 0.1, 0.02, 1e-7
#: Trials that a result counts as at least, when the bound is deflated for having looked often.
TRIALS = 45
#: Bets a window and all windows together need.
LEAST_WINDOW, LEAST_POOLED = 30, 2500

#: (rows to fit with win, x columns and y; rows to score with win) -> the latter with the double ``raw``.
Model = Callable[[DataFrame, DataFrame], DataFrame]


def fingerprint(df: DataFrame, *columns: str) -> str:
    """Rows, and the sums of two 60-bit halves of each row's MD5: the same in any order and partitioning, another if a row comes, goes or changes. Columns must print alike everywhere (no doubles)."""
    text = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns)))
    half = lambda at: F.sum(F.conv(F.substring(text, at, 15), 16, 10).cast("decimal(20,0)"))
    n, a, b = df.agg(F.count("*"), half(1), half(16)).first()
    return f"{n}:{a or 0}:{b or 0}"


def frozen(rows: DataFrame, path: str, *columns: str) -> DataFrame:
    """The rows as they were frozen at ``path``, which the first call writes; ValueError if the given ones differ in any of the columns (see ``fingerprint``)."""
    spark = rows.sparkSession
    try:
        held = spark.read.schema(rows.schema).parquet(path)
    except AnalysisException:  # nothing frozen yet
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)
    was, now = fingerprint(held, *columns), fingerprint(rows, *columns)
    if was != now:
        raise ValueError(f"the rows are {now}, frozen as {was}")
    return held


def line_model(x: str) -> Model:
    """A straight line on one feature for each window, kept within 0 and 1."""

    def model(fit: DataFrame, rows: DataFrame) -> DataFrame:
        m = fit.groupBy("win").agg(F.regr_slope("y", x).alias("_b"), F.regr_intercept("y", x).alias("_a"))
        z = F.col("_a") + F.col("_b") * F.col(x)
        p = F.when(z.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), z)))  # greatest and least pass over nulls
        return rows.join(F.broadcast(m), "win").withColumn("raw", p).drop("_a", "_b")  # one row a window

    return model


def windows(rows: DataFrame, pins: DataFrame, embargo: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows to fit, to calibrate, to judge) of each window, with ``win``; rows have ``at`` in ms, pins win, start and stop.

    Training ends an embargo before the window. Its last tenth in time
    calibrates, again an embargo behind the rows that are fitted. Windows with
    fewer than ``least`` training rows, or none to judge, are left out.
    """
    pins = F.broadcast(pins)  # as many rows as windows
    past = rows.join(pins, F.col("at") < F.col("start") - embargo).drop("start", "stop")
    # rows share their times, so the distinct ones of a window are counted first
    times = past.groupBy("win", "at").agg(F.count("*").alias("n"))
    cuts = times.groupBy("win").agg(F.round(F.percentile("at", 1 - CALIBRATION, F.col("n"))).cast("long").alias("cut"), F.sum("n").alias("n")).filter(F.col("n") >= least).select("win", "cut")
    split = past.join(F.broadcast(cuts), "win")
    judged = rows.join(pins, (F.col("at") >= F.col("start")) & (F.col("at") < F.col("stop"))).drop("start", "stop").join(F.broadcast(cuts.select("win")), "win")
    return split.filter(F.col("at") < F.col("cut")).drop("cut"), split.filter(F.col("at") >= F.col("cut") + embargo).drop("cut"), judged


def judge(rows: DataFrame, pins: DataFrame, model: Model, embargo: int, least: int = 5000) -> DataFrame:
    """The rows of each window with ``raw``, calibrated ``p``, ``right`` and, for each coverage, ``sure``: one plan from fits to choices.

    A row is sure when its distance from 0.5, raw distances breaking the ties of
    plateaus, reaches the quantile of the calibration rows that the coverage names.
    Rows that the model gives no score, and windows with none to calibrate, are left out.
    """
    fit, calibration, judged = windows(rows, pins, embargo, least)
    both = model(fit, calibration.withColumn("_judged", F.lit(False)).unionByName(judged.withColumn("_judged", F.lit(True))))
    both = both.withColumn("raw", F.round("raw", 4)).filter("raw IS NOT NULL")
    curves = mo.isotonic_fit(both.filter("NOT _judged"), "win", "raw", "y").select("win", "xs", "ys")
    both = both.join(F.broadcast(curves), "win").withColumn("p", mo.piecewise(F.col("raw"), F.col("xs"), F.col("ys"))).drop("xs", "ys")
    both = both.withColumn("_score", F.round(F.abs(F.col("p") - 0.5) + TIES * F.abs(F.col("raw") - 0.5), 12))
    limits = both.filter("NOT _judged").groupBy("win").agg(*(F.round(F.percentile("_score", 1 - c), 12).alias(f"_limit{i}") for i, c in enumerate(COVERAGES)))
    out = both.filter("_judged").join(F.broadcast(limits), "win")
    sure = F.array(*(F.col("_score") >= F.col(f"_limit{i}") for i in range(len(COVERAGES))))
    return out.withColumns({"sure": sure, "right": (F.col("p") > 0.5) == (F.col("y") == 1)}).drop("_judged", "_score", *(f"_limit{i}" for i in range(len(COVERAGES))))


def by_window(judged: DataFrame) -> DataFrame:
    """win, coverage, n_test, n, hit, and the coverage that came out; n 0 where nothing was sure enough."""
    each = judged.select("win", "right", F.posexplode("sure").alias("i", "taken"))
    g = each.groupBy("win", "i").agg(F.count("*").alias("n_test"), F.count_if("taken").alias("n"), F.count_if(F.col("taken") & F.col("right")).alias("_won"))
    coverage = F.element_at(F.array(*map(F.lit, COVERAGES)), F.col("i") + 1)
    return g.select("win", coverage.alias("coverage"), "n_test", "n", (F.col("_won") / F.nullif("n", F.lit(0))).alias("hit"), (F.col("n") / F.col("n_test")).alias("real_coverage"), F.col("_won").alias("won"))


def bounds(trials: int) -> tuple[float, float]:
    """z of a one-sided 95 % bound, plain and deflated by the trials."""
    z = NormalDist().inv_cdf
    return z(0.95), z(1 - 0.05 / max(TRIALS, trials + 1))


def pooled(each: DataFrame, trials: int = 0) -> DataFrame:
    """All windows of ``by_window`` together, a row a coverage: hit-rate, lower bounds, windows with enough bets and over a half, value at even odds after the fee."""
    plain, deflated = bounds(trials)
    enough: Column = F.col("n") >= LEAST_WINDOW
    g = each.groupBy("coverage").agg(
        F.sum("n").alias("n"), F.sum("won").alias("_won"), F.count("*").alias("_windows"), F.count_if(enough).alias("windows_enough"), F.count_if(enough & (F.col("hit") > 0.5)).alias("windows_above")
    )
    hit = F.col("_won") / F.nullif("n", F.lit(0))
    low = lambda z: F.when(F.col("n") > 0, st.wilson(F.col("_won"), F.col("n"), z)[0])
    return g.select(
        "coverage", "n", hit.alias("hit"), low(plain).alias("low"), low(deflated).alias("low_deflated"), "windows_enough", "windows_above",
        ((F.col("n") >= LEAST_POOLED) & (F.col("windows_enough") == F.col("_windows"))).alias("enough"), (2 * hit - 1 - FEE).alias("value"),
    )
