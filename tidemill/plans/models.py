"""Fitting, calibrating and combining simple classifiers.

Linear fits reduce the rows to a small Gram matrix by one aggregation a step,
so only a few numbers reach the driver. Trees are in ``trees``; isotonic fits pool
scores part by part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, x: list[str], y: Column, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """X'WX and X'Wy with a leading constant, by one aggregation."""
    cols = [F.lit(1.0), *map(F.col, x)]
    w = F.lit(1.0) if weight is None else weight
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(*(F.sum(w * cols[i] * cols[j]) for i, j in pairs), *(F.sum(w * c * y) for c in cols)).first()
    a = np.zeros((len(cols), len(cols)))
    for k, (i, j) in enumerate(pairs):
        a[i, j] = a[j, i] = row[k] or 0.0
    return a, np.array([v or 0.0 for v in row[len(pairs) :]])


def solve(a: np.ndarray, b: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Normal equations; zeros where they have no finite answer. The constant isn't shrunk."""
    a = a + ridge * np.diag([0.0] + [1.0] * (len(b) - 1))
    try:
        out = np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.zeros(len(b))
    return out if np.isfinite(out).all() else np.zeros(len(b))


def linear_fit(df: DataFrame, x: list[str], y: str, ridge: float = 0.0) -> np.ndarray:
    return solve(*gram(df, x, F.col(y)), ridge)


def linear(beta, x: list[str]) -> Column:
    out = F.lit(float(beta[0]))
    for b, c in zip(beta[1:], x, strict=True):
        out = out + F.lit(float(b)) * F.col(c)
    return out


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def logistic_fit(df: DataFrame, x: list[str], y: str, l2: float = 0.0, steps: int = 20, tol: float = 1e-6) -> np.ndarray:
    """Iteratively reweighted least squares; each step is one aggregation over the rows, which are cached meanwhile."""
    df = df.select(*x, y).persist()
    try:
        return _reweighted(df, x, y, l2, steps, tol)
    finally:
        df.unpersist()


def _reweighted(df: DataFrame, x: list[str], y: str, l2: float, steps: int, tol: float) -> np.ndarray:
    for ridge in (l2, 0.1, 1.0, 10.0):
        beta = np.zeros(len(x) + 1)
        for _ in range(steps):
            z = linear(beta, x)
            p = sigmoid(z)
            w = F.greatest(p * (1 - p), F.lit(1e-6))
            new = solve(*gram(df, x, z + (F.col(y) - p) / w, w), ridge)
            moved, beta = np.abs(new - beta).max(), new
            if not np.isfinite(beta).all() or np.abs(beta).max() > 1e6:
                break
            if moved < tol:
                return beta
    return beta


def majority_vote(votes: list[Column], confidences: list[Column] | None = None) -> tuple[Column, Column]:
    """(p_up, confidence): 0.5 plus or minus half the winning share; ties go up, NULL votes don't count."""
    confidences = confidences or [F.lit(0.5)] * len(votes)
    total = lambda cs: sum(cs[1:], cs[0])
    ups, downs = (total([F.when(v >= 0.5, 1).otherwise(0) if up else F.when(v < 0.5, 1).otherwise(0) for v in votes]) for up in (True, False))
    weigh = lambda up: total([F.when(v >= 0.5 if up else v < 0.5, F.coalesce(c, F.lit(0.5))).otherwise(0.0) for v, c in zip(votes, confidences, strict=True)])
    n = ups + downs
    p = F.when(n > 0, F.when(ups >= downs, 0.5 + 0.5 * ups / n).otherwise(0.5 - 0.5 * downs / n))
    conf = F.when(n > 0, F.when(ups >= downs, weigh(True) / F.greatest(ups, F.lit(1))).otherwise(weigh(False) / F.greatest(downs, F.lit(1)))).otherwise(0.5)
    return p, conf


#: Parts of the unit interval that scores are first pooled in, and neighbouring parts that merge at a time.
PARTS, MERGED = 64, 8


def pooled(n, s, lo, hi) -> list[tuple[float, float, float, float]]:
    """Neighbouring blocks (rows, sum of y, first and last score; ascending) pooled until their means ascend.

    Pooling parts first and then their blocks gives what pooling all at once gives, so parts may lie in several tasks.
    """
    out: list[tuple[float, float, float, float]] = []
    for block in zip(map(float, n), map(float, s), map(float, lo), map(float, hi), strict=True):
        while out and out[-1][1] * block[0] >= block[1] * out[-1][0]:
            before = out.pop()
            block = (before[0] + block[0], before[1] + block[1], before[2], block[3])
        out.append(block)
    return out


def isotonic_fit(df: DataFrame, key: str, p: str, y: str) -> DataFrame:
    """(key, xs, ys, n) of each key's isotonic calibration: the two ends of every pooled block, at its mean; xs strictly ascending; and its rows.

    Equal scores are pooled first, then those of each of PARTS parts of the unit
    interval, then MERGED neighbouring parts at a time: a key with a large share
    of the rows is many groups until only its blocks are left.
    """
    part = F.greatest(F.lit(0), F.least(F.lit(PARTS - 1), F.floor(F.col(p) * PARTS))).cast("int")
    kind = dict(df.dtypes)[key]
    blocks = df.groupBy(key, p).agg(F.count("*").cast("double").alias("n"), F.sum(y).cast("double").alias("s"))
    blocks = blocks.select(key, part.alias("part"), "n", "s", F.col(p).cast("double").alias("lo"), F.col(p).cast("double").alias("hi"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lo")
        out = pd.DataFrame(pooled(pdf["n"], pdf["s"], pdf["lo"], pdf["hi"]), columns=["n", "s", "lo", "hi"])
        return out.assign(**{key: pdf[key].iloc[0], "part": pdf["part"].iloc[0]})[[key, "part", "n", "s", "lo", "hi"]]

    parts = PARTS
    while True:
        blocks = blocks.groupBy(key, "part").applyInPandas(merge, f"{key} {kind}, part int, n double, s double, lo double, hi double")
        if parts == 1:
            break
        parts = -(-parts // MERGED)
        blocks = blocks.withColumn("part", F.floor(F.col("part") / MERGED).cast("int"))
    ends = F.when(F.col("lo") < F.col("hi"), F.array("lo", "hi")).otherwise(F.array("lo"))
    fit = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("lo", ends.alias("xs"), (F.col("s") / F.col("n")).alias("y")))).alias("b"), F.sum("n").cast("long").alias("n"))
    return fit.select(key, F.flatten("b.xs").alias("xs"), F.flatten(F.transform("b", lambda b: F.transform(b["xs"], lambda _: b["y"]))).alias("ys"), "n")


def calibrated(rows: DataFrame, fits: DataFrame, key: str, p: str, least: int, shrink: float, blend: float = 0.5) -> DataFrame:
    """rows with p calibrated in three forms by the curves of ``isotonic_fit`` for each key and for all rows together (key "all").

    own: the key's curve, the common one where it rests on fewer than ``least``
    rows; mixed: ``blend`` of the common curve where the key has its own; shrunk:
    the key's curve by n / (n + shrink), the common one by the rest. A ten
    thousandth of the raw score keeps ties of plateaus in order.
    """
    common = fits.filter(F.col(key) == "all").select(F.col("xs").alias("_gx"), F.col("ys").alias("_gy"))  # one row
    own = fits.filter(F.col(key) != "all").select(key, F.col("xs").alias("_kx"), F.col("ys").alias("_ky"), F.col("n").alias("_kn"))
    joined = rows.join(F.broadcast(common)).join(own, key, "left")
    whole, part = piecewise(F.col(p), F.col("_gx"), F.col("_gy")), piecewise(F.col(p), F.col("_kx"), F.col("_ky"))
    n = F.coalesce("_kn", F.lit(0))
    share = n / (n + shrink)
    forms = {
        "own": F.when(n >= least, part).otherwise(whole),
        "mixed": F.when(n >= least, blend * whole + (1 - blend) * part).otherwise(whole),
        "shrunk": F.when(n > 0, share * part + (1 - share) * whole).otherwise(whole),
    }
    kept = lambda v: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), v + 1e-4 * (F.col(p) - 0.5)))
    return joined.select(*rows.columns, *(kept(v).alias(k) for k, v in forms.items()))


def piecewise(p: Column, xs: Column, ys: Column) -> Column:
    """Linear between breakpoints, flat outside, as it is without any."""
    i = F.size(F.filter(xs, lambda x: x <= p))
    n = F.size(xs)
    lo, hi = F.greatest(i, F.lit(1)), F.least(i + 1, n)
    x0, x1, y0, y1 = (F.element_at(c, k) for c, k in ((xs, lo), (xs, hi), (ys, lo), (ys, hi)))
    mixed = y0 + (p - x0) / F.nullif(x1 - x0, F.lit(0.0)) * (y1 - y0)
    return F.when(n == 0, p).when(i == 0, F.element_at(ys, F.lit(1))).when(i == n, F.element_at(ys, F.lit(-1))).otherwise(mixed)


def ood_guard(features: list[Column], means: list[Column], stds: list[Column], p: Column, limit: float = 8.0, least: int = 3) -> Column:
    """0.5 where ``least`` features or more lie over ``limit`` deviations out."""
    far = [F.when(F.abs((f - m) / F.nullif(s, F.lit(0.0))) > limit, 1).otherwise(0) for f, m, s in zip(features, means, stds, strict=True)]
    return F.when(sum(far[1:], far[0]) >= least, 0.5).otherwise(p)
