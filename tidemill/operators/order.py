"""Order statistics of long trailing frames: a rank structure over blocks of rows, O(log n) a row.

A series is cut into blocks of rows, and each block also gets the rows of the
frame that reaches back from its first one. So blocks stand alone, a long series
spreads over many tasks, and none holds more than a block and a frame.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, at least; bars of a span in which rows are counted first.
BLOCK, SPAN = 4096, 512


class Ranks:
    """How many of the held values there are at each rank: a Fenwick tree."""

    def __init__(self, size: int):
        self.size, self.top = size, 1 << max(0, size.bit_length() - 1)
        self.tree = [0] * (size + 1)

    def add(self, rank: int, n: int) -> None:
        tree, k = self.tree, rank + 1
        while k <= self.size:
            tree[k] += n
            k += k & -k

    def below(self, rank: int) -> int:
        """Values of ranks under this one."""
        tree, k, n = self.tree, rank, 0
        while k:
            n += tree[k]
            k &= k - 1
        return n

    def at(self, place: int) -> int:
        """The rank of the value at this place (from 0) in ascending order."""
        tree, k, step = self.tree, 0, self.top
        while step:
            if k + step <= self.size and tree[k + step] <= place:
                k += step
                place -= tree[k]
            step >>= 1
        return k


def trailing(values: np.ndarray, first: int, n: int, quantiles: Iterable[float] = (0.5,)) -> tuple[np.ndarray, list[np.ndarray]]:
    """Average-tie percentile ranks, and interpolated quantiles, of values[first:] in frames of n rows; NaN neither counts nor has a rank."""
    known = ~np.isnan(values)
    distinct, codes = np.unique(values[known], return_inverse=True)
    code = np.full(len(values), -1)
    code[known] = codes
    code, levels = code.tolist(), distinct.tolist()
    held, count, quantiles = Ranks(len(levels)), 0, list(quantiles)
    ranks, found = np.full(len(values) - first, np.nan), [np.full(len(values) - first, np.nan) for _ in quantiles]
    for i, c in enumerate(code):
        if c >= 0:
            held.add(c, 1)
            count += 1
        if i >= n and code[i - n] >= 0:
            held.add(code[i - n], -1)
            count -= 1
        if i < first or not count:
            continue
        if c >= 0:
            less, upto = held.below(c), held.below(c + 1)
            ranks[i - first] = (less + (upto - less + 1) / 2) / count
        for q, out in zip(quantiles, found, strict=True):
            at = q * (count - 1)
            low = int(at)
            a = levels[held.at(low)]
            b = levels[held.at(low + 1)] if at > low else a
            out[i - first] = a + (at - low) * (b - a)
    return ranks, found


def numbered(df: DataFrame, width: int) -> DataFrame:
    """df with ``_k``, the number from 0 of each row in its symbol's time order: counted by spans of time, so no task sorts a whole series."""
    span = df.withColumn("_span", F.floor(F.col("open_time") / (SPAN * width)))
    sizes = span.groupBy("symbol", "_span").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("symbol").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("symbol", "_span", before.alias("_before"))  # a row a span
    inner = Window.partitionBy("symbol", "_span").orderBy("open_time")
    return span.withColumn("_k", F.row_number().over(inner) - 1).join(starts, ["symbol", "_span"]).withColumn("_k", F.col("_k") + F.col("_before")).drop("_span", "_before")


def order_statistics(df: DataFrame, c: str, n: int, width: int, quantiles: dict[str, float] | None = None) -> DataFrame:
    """(symbol, open_time, prank, quantiles...) of column c over the last n rows (fewer at the start) of bars about ``width`` ms apart."""
    quantiles = {"med": 0.5} if quantiles is None else quantiles
    size = max(BLOCK, n)
    rows = numbered(df.select("symbol", "open_time", F.col(c).cast("double").alias("_v")), width)
    own = F.floor(F.col("_k") / size)
    dealt = rows.withColumn("_block", F.explode(F.when(F.col("_k") >= (own + 1) * size - (n - 1), F.array(own, own + 1)).otherwise(F.array(own))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k")
        first = int((pdf["_k"] // size < pdf["_block"]).sum())
        ranks, found = trailing(pdf["_v"].to_numpy(float), first, n, quantiles.values())
        return pdf[["symbol", "open_time"]].iloc[first:].assign(prank=ranks, **dict(zip(quantiles, found, strict=True)))

    names = ["prank", *quantiles]
    out = dealt.groupBy("symbol", "_block").applyInPandas(run, "symbol string, open_time long, " + ", ".join(f"{x} double" for x in names))
    return out.select("symbol", "open_time", *(F.when(~F.isnan(x), F.col(x)).alias(x) for x in names))
