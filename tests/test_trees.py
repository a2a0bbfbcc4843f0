"""Boosted trees against an enumeration of every split on small tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.plans import trees as tr


def enumerated(x: np.ndarray, ids: np.ndarray, y: np.ndarray, how: tr.Boosting, seed: int) -> np.ndarray:
    """Margins after boosting row by row: every midpoint of every drawn feature is tried at every node."""
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    margin = np.full(len(y), np.log(share / (1 - share)))
    score = lambda g, h: g.sum() ** 2 / (h.sum() + how.l2)
    for t in range(how.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        drawn = tr._drawn(ids, np.full(len(ids), seed), t, how.rows)
        add = np.zeros(len(y))

        def grow(node, rows, everyone, depth):
            own = rows[drawn[rows]]
            add[everyone] = -g[own].sum() / (h[own].sum() + how.l2)
            if depth == how.depth or len(own) < 2 * how.leaf:
                return
            features = range(x.shape[1])
            if how.columns < 1:
                features = np.random.default_rng([seed, t, node]).permutation(x.shape[1])[: max(1, int(x.shape[1] * how.columns))]
            best = (0.0, 0, 0.0)
            for f in sorted(features):
                values = np.unique(x[:, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    left, right = own[x[own, f] < cut], own[x[own, f] >= cut]
                    if min(len(left), len(right)) >= how.leaf:
                        gain = 0.5 * (score(g[left], h[left]) + score(g[right], h[right]) - score(g[own], h[own])) - how.gamma
                        if gain > best[0] + 1e-9:
                            best = (gain, f, cut)
            if best[0] > 0:
                side = x[:, best[1]] >= best[2]
                grow(2 * node, rows[~side[rows]], everyone[~side[everyone]], depth + 1)
                grow(2 * node + 1, rows[side[rows]], everyone[side[everyone]], depth + 1)

        everyone = np.arange(len(y))
        grow(1, everyone, everyone, 0)
        margin = margin + how.rate * add
    return margin


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(500, 3)), 2)
    model = np.arange(500) % 3
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3 * model)).astype(float)
    return pd.DataFrame({"model": model.astype("int32"), "id": np.arange(500) * 7 - 900, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})


@pytest.mark.parametrize("how", [tr.Boosting(5, 3, 0.3, 8, 1.0, 1.0, 1.0, 0.0, 4096), tr.Boosting(6, 2, 0.5, 5, 0.6, 0.7, 2.0, 0.1, 4096)], ids=["whole", "drawn"])
@pytest.mark.parametrize("dealt", ["one task", "many tasks", "many sums"])
def test_every_split_tried(spark, table, how, dealt, monkeypatch):
    """Whole and drawn fits of three models at once, margins written out in between, however rows are dealt."""
    monkeypatch.setattr(tr, "REBASE", 2)
    if dealt != "one task":
        monkeypatch.setattr(tr, "ROWS", 60)
        monkeypatch.setattr(tr, "FEW", 16 if dealt == "many tasks" else 0)
    df = spark.createDataFrame(table)
    ens = tr.fit(df, ["a", "b", "c"], how, [1, 2, 3])
    found = tr.predict(df.drop("y"), ens).toPandas().sort_values("id")["p"].to_numpy()
    want = np.zeros(len(table))
    for m in range(3):
        own = (table["model"] == m).to_numpy()
        t = table[own]
        want[own] = 1 / (1 + np.exp(-enumerated(t[["a", "b", "c"]].to_numpy(), t["id"].to_numpy(), t["y"].to_numpy(), how, m + 1)))
    assert np.allclose(found, want, atol=1e-6)
    assert ens.gain.sum() > 0 and any(f is not None for *_, f, _, _ in ens.splits())


def test_learns_what_no_line_can(spark):
    """An exclusive or of two signs, with few bins; a bag of folds judges only rows behind its training rows; a model without rows gives one half."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 2))
    df = spark.createDataFrame(pd.DataFrame({"g": "all", "at": np.arange(3000), "id": np.arange(3000), "a": x[:, 0], "b": x[:, 1], "y": ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)}))
    folds = spark.createDataFrame([("all", 0, 0, 0, 100), ("all", 1, 2400, 2410, 3000)], "g string, fold int, train_to long, test_from long, test_to long")
    out, _ = tr.bagged(df, ["g"], folds, ["a", "b"], "y", tr.Boosting(rounds=20, rate=0.2, bins=64), 2)
    out = out.toPandas()
    assert set(out[out["fold"] == 0]["p"]) == {0.5} and len(out) == 690
    late = out[out["fold"] == 1]
    assert late["at"].min() == 2410 and ((late["p"] >= 0.5) == (late["y"] == 1)).mean() > 0.85


def test_no_rows(spark, table):
    none = spark.createDataFrame(table).filter("false")
    ens = tr.fit(none, ["a"], tr.Boosting(rounds=3), [1])
    assert [r.p for r in tr.predict(spark.createDataFrame(table).filter("id = -900").withColumn("model", F.lit(0)), ens).collect()] == [0.5]


@pytest.mark.parametrize("few", [16, 0], ids=["by model", "by rows"])
def test_driver_gets_splits_alone(spark, table, few, monkeypatch):
    """A row for each node of a level, however many bins there are."""
    got, whole = [], type(spark.range(0)).toArrow

    def counted(df):
        out = whole(df)
        got.append(out.num_rows)
        return out

    monkeypatch.setattr(type(spark.range(0)), "toArrow", counted)
    monkeypatch.setattr(tr, "ROWS", 60)
    monkeypatch.setattr(tr, "FEW", few)
    tr.fit(spark.createDataFrame(table), ["a", "b", "c"], tr.Boosting(2, 3, 0.3, 8), [1, 2, 3])
    assert len(got) == 6 and max(got) <= 3 * 4 and got[0] == 3
