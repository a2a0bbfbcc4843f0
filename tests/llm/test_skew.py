"""Lookups of frequent keys, and components, against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemill.llm import skew
from tidemill.llm import textkit as tk
from tidemill.llm.components import components


@pytest.mark.parametrize("hot", [0, 1, 3, 10_000])
def test_lookup(spark, monkeypatch, hot):
    """Whichever keys are met by broadcast, each row gets its key's value; unknown and null keys get none."""
    monkeypatch.setattr(skew, "HOT_KEYS", hot)
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, 4, 5, None]), i % 2) for i in range(200)]
    table = {(k, j): f"v{k}{j}" for k in (1, 2, 3, 9) for j in (0, 1)}
    left = spark.createDataFrame(rows, "id long, k long, j long")
    right = spark.createDataFrame([(k, j, v, None) for (k, j), v in table.items()], "k long, j long, v string, w long")
    top = skew.frequent(left.filter("k IS NOT NULL").groupBy("k", "j").agg(F.count("*").alias("n")), "n")
    got = {r.id: (r.k, r.j, r.v, r.w) for r in skew.lookup(left, right, ["k", "j"], ["v", "w"], top, F.col("id")).collect()}
    assert got == {i: (k, j, table.get((k, j)), None) for i, k, j in rows}


@pytest.mark.parametrize("hot", [1, 10_000])
def test_components(spark, monkeypatch, hot):
    """A star, a long chain, a ring and pairs."""
    monkeypatch.setattr(skew, "HOT_KEYS", hot)
    edges = [(0, i) for i in range(1000, 1300)] + [(i, i + 1) for i in range(2000, 2060)] + [(3000 + i, 3000 + (i + 1) % 9) for i in range(9)] + [(5, 4), (4, 5), (7, 7)]
    with tk.Workspace(spark, "test") as work:
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), work, "t").collect()}
    assert got == {0: 0, **{i: 0 for i in range(1000, 1300)}, **{i: 2000 for i in range(2000, 2061)}, **{i: 3000 for i in range(3000, 3009)}, 4: 4, 5: 4}


def test_workspace_drops_all_but_results(spark):
    with tk.Workspace(spark, "test") as work:
        work.save(spark.range(3).toDF("x"), "table")
        kept = work.keep(spark.range(5).toDF("x"))
        path = spark._jvm.org.apache.hadoop.fs.Path(work.root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        assert fs.exists(path)
    assert not fs.exists(path) and kept.count() == 5
