"""Flows of features, models and stakes: steps from DataFrame to DataFrame, chained with ``transform`` into one lazy plan.

Each step adds columns to the frame of decisions, so Catalyst sees one plan and
sorts each series once.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import sizing as sz
from tidemill.plans import models as mo

Step = Callable[[DataFrame], DataFrame]


def pack(build) -> Step:
    """A feature pack that keeps the columns that are there."""
    return lambda df: build(df, carry=True)


def matrix(columns: list[str]) -> Step:
    """Named features in order as ``matrix``; a row with a missing one is filled with 0 and not ``ready``."""
    values = [F.col(c).cast("double") for c in columns]
    missing = F.array_contains(F.array(*(v.isNull() for v in values)), True)
    return lambda df: df.withColumns({"matrix": F.array(*(F.coalesce(v, F.lit(0.0)) for v in values)), "ready": ~missing})


def logistic(weights: list[float], bias: float) -> Step:
    """``p_up`` by fixed weights over the matrix, 0.5 where it isn't ready, and ``confidence``, twice the distance from 0.5."""
    z = F.aggregate(F.zip_with("matrix", F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(bias), lambda a, x: a + x)
    p = F.when(F.col("ready"), mo.sigmoid(z)).otherwise(0.5)
    return lambda df: df.withColumn("p_up", p).withColumn("confidence", F.abs(F.col("p_up") - 0.5) * 2)


def linear(weights: list[float], intercept: float, anchor: str) -> Step:
    """``predicted`` by fixed weights over the matrix; ``p_up`` 1 or 0 by whether it reaches the anchor, and ``confidence``, ten times the distance as a share of it, at most 1. NULL until ready, and without an anchor but for the price."""
    y = F.when(F.col("ready"), F.aggregate(F.zip_with("matrix", F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(intercept), lambda a, x: a + x))
    at = F.col(anchor)
    sure = F.when((at != 0) & F.col("predicted").isNotNull(), F.least(F.lit(1.0), F.abs((F.col("predicted") - at) / at) * 10))
    return lambda df: df.withColumn("predicted", y).withColumns({"p_up": (F.col("predicted") >= at).cast("double"), "confidence": sure})


def output(p_up: Column, confidence: Column | None = None, predicted: Column | None = None, p05: Column | None = None, p50: Column | None = None, p95: Column | None = None, reasoning: Column | None = None) -> list[Column]:
    """The columns of a prediction; what is not given is NULL, but for the confidence, which is 0.5."""
    none = lambda c, t="double": F.lit(None).cast(t) if c is None else c
    found = {"p_up": p_up, "confidence": F.coalesce(none(confidence), F.lit(0.5)), "predicted": none(predicted), "p05": none(p05), "p50": none(p50), "p95": none(p95), "reasoning": none(reasoning, "string")}
    return [c.alias(n) for n, c in found.items()]


def code(name: str, inputs: list[str], function: Callable[..., pd.Series]) -> Step:
    """A user's function from Series to Series, in batches in the workers; results are rounded to nine decimals, so that replays agree."""

    @F.pandas_udf("double")
    def run(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(function(*(frame[n] for n in inputs)), index=frame.index).astype(float).round(9)

    return lambda df: df.withColumn(name, run(F.struct(*(F.col(n).cast("double").alias(n) for n in inputs))))


def edge_kelly(price: float, bank: float) -> Step:
    """A quarter of the Kelly stake of the likelier side, nothing under 1; and the ``side``."""
    p = F.col("p_up")
    stake = F.round(0.25 * F.greatest(sz.full_kelly(F.greatest(p, 1 - p), F.lit(price)), F.lit(0.0)) * bank, 2)
    return lambda df: df.withColumns({"stake": F.when(stake >= 1, stake).otherwise(0.0), "side": F.when(p >= 0.5, "UP").otherwise("DOWN")})


def gate(band: float) -> Step:
    """No stake near 0.5."""
    return lambda df: df.withColumn("stake", F.when(sz.no_bet(F.col("p_up"), band), 0.0).otherwise(F.col("stake")))


def clamp_round(low: float = 0.0, high: float = 1e12) -> Step:
    """Stakes kept within bounds and rounded to whole ones."""
    return lambda df: df.withColumn("stake", F.round(F.least(F.lit(high), F.greatest(F.lit(low), F.col("stake"))), 0))


def chain(df: DataFrame, *steps: Step) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df
