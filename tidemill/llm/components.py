"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.skew import frequent, lookup
from tidemill.llm.textkit import Workspace


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the least node reachable.

    Each round takes the least label among neighbours, then the label of that
    label, so long chains shrink by half at least; rounds are written out. The
    middle of a star and the least node of a large component are keys of very
    many rows: they are looked up apart (see ``skew``).
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct().toDF("node", "other")
    both = work.save(both, f"{name}-both")
    degrees = both.groupBy("node").agg(F.min("other").alias("least"), F.count("*").alias("n"))
    degrees = work.save(degrees, f"{name}-degrees")
    middles = work.save(frequent(degrees.select("node", "n"), "n"), f"{name}-middles").select("node")
    labels = work.save(degrees.select("node", F.least("node", "least").alias("component")), f"{name}-0")
    step = 0
    while True:
        step += 1
        seen = lookup(both, labels.toDF("other", "component"), ["other"], ["component"], middles.toDF("other"), F.col("node"))
        offered = seen.groupBy("node").agg(F.min("component").alias("near"))
        met = labels.join(offered, "node").select("node", F.least("component", "near").alias("next"), F.col("component").alias("old"))
        met = work.save(met, f"{name}-met")
        roots = frequent(met.groupBy("next").agg(F.count("*").alias("n")), "n").select("next")
        far = lookup(met, labels.toDF("next", "jump"), ["next"], ["jump"], roots, F.col("node"))
        moved = work.save(far.select("node", F.least("next", "jump").alias("component"), "old"), f"{name}-{step}")
        changed = moved.filter("component <> old").limit(1).count()
        labels = moved.select("node", "component")
        for used in (f"{name}-{step - 1}", f"{name}-met"):
            work.drop(used)
        if not changed:
            return labels
