"""Fits that SQL cannot say, against direct computations over the smallest tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tidemill.plans import models as mo
from tidemill.queries import models as q


@pytest.fixture(scope="module")
def training(spark, sf_dir):
    rows, cols = q._training(spark, sf_dir)
    return rows, cols, rows.toPandas()


def dense(pdf: pd.DataFrame, cols: list[str]) -> np.ndarray:
    """Newton's method on the whole matrix; the constant isn't shrunk."""
    x = np.concatenate([np.ones((len(pdf), 1)), pdf[cols].to_numpy(float)], 1)
    y, beta = pdf["y"].to_numpy(float), np.zeros(len(cols) + 1)
    ridge = np.diag([0.0] + [1.0] * len(cols))
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
    return beta


def test_irls_is_the_dense_solve(spark, sf_dir, training):
    _, cols, pdf = training
    found = {r.term: r.beta for r in q.model_irls(spark, sf_dir).collect()}
    assert [found[c] for c in ["const", *cols]] == pytest.approx(dense(pdf, cols), abs=2e-5)


def test_permutation_importance(spark, sf_dir, training):
    rows, cols, pdf = training
    from pyspark.sql import functions as F

    order = rows.select("symbol", "open_time", F.xxhash64("open_time", F.lit(3)).alias("h")).toPandas()
    pdf = pdf.merge(order, on=["symbol", "open_time"])
    beta = mo.logistic_fit(rows, cols, "y", l2=1.0)
    x, y = pdf[cols].to_numpy(float), pdf["y"].to_numpy()
    dealt = np.empty_like(x)
    for _, g in pdf.groupby("symbol"):
        dealt[g.sort_values("open_time").index] = x[g.sort_values(["h", "open_time"]).index]
    hit = lambda z: float(((beta[0] + z @ beta[1:] >= 0) == (y == 1)).mean())
    for r in q.model_permutation_importance(spark, sf_dir).collect():
        other, k = x.copy(), cols.index(r.feature)
        # rank k of time takes the value that rank k of the hash has
        other[:, k] = dealt[:, k]
        assert r.importance == pytest.approx(hit(x) - hit(other), abs=2e-6)


def test_isotonic_golden(spark):
    """Both ends of a pooled block at its mean; single points once; interpolation between."""
    rows = [("a", 0.4, 1.0), ("a", 0.6, 0.0), ("b", 0.2, 0.0), ("b", 0.3, 1.0), ("b", 0.5, 0.0), ("b", 0.9, 1.0), ("c", 0.5, 1.0), ("c", 0.5, 0.0)]
    fits = {r.k: (r.xs, r.ys) for r in mo.isotonic_fit(spark.createDataFrame(rows, "k string, p double, y double"), "k", "p", "y").collect()}
    assert fits == {"a": ([0.4, 0.6], [0.5, 0.5]), "b": ([0.2, 0.3, 0.5, 0.9], [0.0, 0.5, 0.5, 1.0]), "c": ([0.5], [0.5])}


def test_isotonic_in_parts(spark):
    """However scores are parted, the curves are those of pooling all at once."""
    rng = np.random.default_rng(6)
    p = np.round(rng.uniform(-0.1, 1.1, 4000), 3)
    pdf = pd.DataFrame({"k": np.where(rng.random(4000) < 0.9, "hot", "cold"), "p": p, "y": (rng.random(4000) < 0.3 + 0.4 * (p > 0.5) + 0.1 * np.sin(30 * p)).astype(float)})
    for r in mo.isotonic_fit(spark.createDataFrame(pdf), "k", "p", "y").collect():
        g = pdf[pdf["k"] == r.k].groupby("p")["y"].agg(["count", "sum"]).reset_index()
        whole = mo.pooled(g["count"], g["sum"], g["p"], g["p"])
        assert r.n == g["count"].sum()
        assert r.xs == [x for _, _, a, b in whole for x in dict.fromkeys((a, b))]
        assert r.ys == pytest.approx([s / n for n, s, a, b in whole for _ in dict.fromkeys((a, b))])
        assert len(whole) < len(g) / 5 and (np.diff(r.ys) >= 0).all()


def test_mondrian_judges_rows_it_was_not_fitted_on(spark, sf_dir):
    from tidemill.sources import decisions as de

    total = de.bets(spark, sf_dir).count()
    rows = q.model_mondrian(spark, sf_dir).collect()
    assert rows and sum(r.n for r in rows) < 0.5 * total
    assert all(0 <= r.calibrated <= 1 for r in rows)
