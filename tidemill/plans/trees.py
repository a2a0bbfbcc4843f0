"""Boosted trees by histograms: many models (a symbol, fold and seed each) grown side by side.

Rows are binned once. A level of a tree is one aggregation of gradients,
Hessians and counts by (model, node, feature, bin), whose size doesn't depend on
the rows; tasks pick the split of each node from it, the driver gets those alone
and sends the trees back. Rows don't move between levels. Every REBASE trees what they add is written into the
rows' margins by a checkpoint, so a task evaluates a bounded number of trees and
a lost executor repeats that many.

Gradients are rounded to a power of two that makes their sums exact, so a fit
does not depend on how rows are dealt.
"""

from __future__ import annotations

import math
import tempfile
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Trees between checkpoints of the margins.
REBASE = 25
#: Rows of a task; and tasks up to which rows are dealt by model instead, so that each has the whole sums of its models.
ROWS, FEW = 8_000, 16


@dataclass(frozen=True)
class Boosting:
    """Logistic loss; Newton leaves -G / (H + l2), gain 0.5 (GL²/(HL+l2) + GR²/(HR+l2) - G²/(H+l2)) - gamma; shares of rows a tree and of features a split."""

    rounds: int = 150
    depth: int = 3
    rate: float = 0.04
    leaf: int = 200
    rows: float = 0.7
    columns: float = 0.7
    l2: float = 1.0
    gamma: float = 0.0
    bins: int = 255


@dataclass
class Ensembles:
    """Trees of models 0 .. n-1: base margins (n), and for each tree and model a complete binary tree by node number (root 1, children 2k and 2k+1; feature -1 is a leaf)."""

    how: Boosting
    x: list[str]
    cuts: list[np.ndarray]
    base: np.ndarray
    feature: list[np.ndarray] = field(default_factory=list)
    bin: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    gain: np.ndarray | None = None

    def splits(self) -> list[tuple]:
        """(model, tree, node, feature or None, threshold or None, value) of every node reached."""
        out = []
        for t, (f, b, v) in enumerate(zip(self.feature, self.bin, self.value, strict=True)):
            for m in range(len(self.base)):
                nodes = [1]
                while nodes:
                    k = nodes.pop()
                    at = int(f[m, k])
                    out.append((m, t, k, self.x[at] if at >= 0 else None, float(self.cuts[at][b[m, k] - 1]) if at >= 0 else None, float(v[m, k])))
                    nodes += [2 * k, 2 * k + 1] if at >= 0 else []
        return out


def cut_points(df: DataFrame, x: list[str], bins: int) -> list[np.ndarray]:
    """Midpoints between neighbouring values of each feature: between all of them if they are few enough, else between quantiles."""
    found = df.agg(*(F.percentile_approx(c, [k / bins for k in range(bins + 1)], 20 * bins) for c in x)).first()
    values = [np.unique(np.array(v or [], float)) for v in found]
    return [(v[1:] + v[:-1]) / 2 for v in values]


def _binned(table, x: list[str], cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, table.column(n).to_numpy(zero_copy_only=False), "right") for n, c in zip(x, cuts, strict=True)], 1).astype(np.uint16)


def _walk(model: np.ndarray, bins: np.ndarray, feature: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Node of each row after ``depth`` levels of its model's tree."""
    node, rows = np.ones(len(model), np.int64), np.arange(len(model))
    for _ in range(depth):
        f = feature[model, node]
        right = bins[rows, np.maximum(f, 0)] >= at[model, node]
        node = np.where(f >= 0, 2 * node + right, node)
    return node


def _drawn(ids: np.ndarray, seed: np.ndarray, tree: int, share: float) -> np.ndarray:
    """A row's draw for a tree, by its id and the model's seed alone."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seed.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(tree * 0x165667B19E3779F9 & (1 << 64) - 1)
        for k, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(k))) * np.uint64(m)
    return (h ^ (h >> np.uint64(31))) < np.uint64(min(share, 1.0) * (1 << 63)) * np.uint64(2) if share < 1 else np.ones(len(ids), bool)


_STATE = "model int, id long, y double, bins binary, margin double"


def _arrays(batch, width: int):
    model, ids, y, margin = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("model", "id", "y", "margin"))
    return model, ids, y, np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint16).reshape(-1, width), margin


def _grown(model, bins, margin, trees, how: Boosting) -> np.ndarray:
    for f, b, v in trees:
        margin = margin + how.rate * v[model, _walk(model, bins, f, b, how.depth)]
    return margin


def _histogram(how: Boosting, width: int, trees: list, now: tuple, level: int, seeds: np.ndarray, tree: int, grid: float):
    """Sums by (model, node, feature, bin) of the rows that stand at nodes of this level and were drawn."""

    def run(batches):
        for batch in batches:
            model, ids, y, bins, margin = _arrays(batch, width)
            keep = _drawn(ids, seeds[model], tree, how.rows)
            node = _walk(model, bins, now[0], now[1], level)
            keep &= node >= 1 << level
            model, node, y, bins = model[keep], node[keep], y[keep], bins[keep]
            p = 1 / (1 + np.exp(-_grown(model, bins, margin[keep], trees, how)))
            g, h = (np.round(v / grid) * grid for v in (p - y, np.maximum(p * (1 - p), 1e-6)))
            key = (((model * (2 << level) + node)[:, None] * width + np.arange(width)) << 16 | bins).ravel()
            key, at = np.unique(key, return_inverse=True)
            sums = [np.bincount(at, None if w is None else np.repeat(w, width), len(key)) for w in (g, h, None)]
            slot, f = np.divmod(key >> 16, width)
            cols = [slot // (2 << level), slot % (2 << level), f, key & 0xFFFF]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*cols, sums[0], sums[1], sums[2].astype(np.int64))], names=["model", "node", "feature", "bin", "g", "h", "n"])

    return run


_SUMS = "model long, node long, feature long, bin long, g double, h double, n long"
_SPLITS = "model long, node long, feature long, bin long, gain double, g double, h double, gl double, hl double"


def _choose(how: Boosting, width: int, bins: int, level: int, seeds: np.ndarray, tree: int):
    """The best split of each node of a level (feature -1 if there is none), with its gain and the sums of the node and of its left child, of the sums of all its bins."""

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            model, node, f, b, g, h, n = (batch.column(c.split()[0]).to_numpy(zero_copy_only=False) for c in _SUMS.split(", "))
            slots, slot = np.unique(model * (2 << level) + node, return_inverse=True)
            dense = np.zeros((len(slots), width, bins, 3))
            np.add.at(dense, (slot, f, b), np.stack([g, h, n], 1))
            for k, s in enumerate(slots.tolist()):
                found[s] = found[s] + dense[k] if s in found else dense[k].copy()
        out = []
        for s, sums in sorted(found.items()):
            m, v = divmod(s, 2 << level)
            left = sums.cumsum(1)
            total = left[0, -1]
            right = total - left
            score = lambda s: s[..., 0] ** 2 / (s[..., 1] + how.l2)
            gain = 0.5 * (score(left) + score(right) - score(total)) - how.gamma
            ok = (left[..., 2] >= how.leaf) & (right[..., 2] >= how.leaf) & (gain > 0)
            if how.columns < 1:
                drawn = np.random.default_rng([int(seeds[m]), tree, v]).permutation(width)[: max(1, int(width * how.columns))]
                ok[np.setdiff1d(np.arange(width), drawn)] = False
            best = np.where(ok, gain, 0.0)
            split = total[2] >= 2 * how.leaf and best.max(initial=0.0) > 0
            j, cut = divmod(int(best.argmax()), bins)
            out.append((m, v, j, cut + 1, best[j, cut], *total[:2], *left[j, cut, :2]) if split else (m, v, -1, 0, 0.0, *total[:2], 0.0, 0.0))
        cols = list(zip(*out, strict=True)) or [()] * 9  # a row a node
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if d.endswith("double") else pa.int64()) for c, d in zip(cols, _SPLITS.split(", "), strict=True)], names=[d.split()[0] for d in _SPLITS.split(", ")])

    return run


def _write(splits, ens: Ensembles, now: tuple) -> None:
    """Write the splits of a level, and the values of its nodes and their children, into the tree ``now``."""
    feature, at, value = now
    l2 = ens.how.l2
    for m, v, j, cut, gain, g, h, gl, hl in sorted(zip(*(splits.column(c.split()[0]).to_pylist() for c in _SPLITS.split(", ")), strict=True)):
        value[m, v] = -g / (h + l2)
        if j >= 0:
            feature[m, v], at[m, v] = j, cut
            ens.gain[m, j] += gain
            value[m, 2 * v], value[m, 2 * v + 1] = -gl / (hl + l2), -(g - gl) / (h - hl + l2)


def fit(members: DataFrame, x: list[str], how: Boosting, seeds: list[int]) -> Ensembles:
    """Ensembles of models 0 .. len(seeds) - 1 on the rows (model int, id long, x..., y 0 or 1, no nulls) that each has; a model without rows has margin 0 and no split."""
    spark = members.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(root or "file://" + tempfile.mkdtemp(prefix="tidemill-"))
    seeds, width = np.array(seeds, np.int64), len(x)
    cuts = cut_points(members, x, how.bins)
    counts = {r.model: (r.n, r.s) for r in members.groupBy("model").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()}  # one row a model
    share = np.array([min(max(s / n, 1e-3), 1 - 1e-3) if (n := counts.get(m, (0, 0))[0]) and (s := counts[m][1]) is not None else 0.5 for m in range(len(seeds))])
    ens = Ensembles(how, x, cuts, np.log(share / (1 - share)), gain=np.zeros((len(seeds), width)))
    rows = sum(n for n, _ in counts.values())
    if not rows:
        return ens
    grid = 2.0 ** -min(30, 52 - math.ceil(math.log2(rows + 1)))
    base = ens.base

    def begin(batches):
        for b in batches:
            model = b.column("model").to_numpy(zero_copy_only=False)
            packed = pa.array([r.tobytes() for r in _binned(b, x, cuts)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("model"), b.column("id"), b.column("y"), packed, pa.array(base[model])], names=["model", "id", "y", "bins", "margin"])

    def rebased(trees: list):
        def run(batches):
            for b in batches:
                model, _, _, bins, margin = _arrays(b, width)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("model", "id", "y", "bins")), pa.array(_grown(model, bins, margin, trees, how))], names=["model", "id", "y", "bins", "margin"])

        return run

    tasks = max(1, -(-rows // ROWS))
    dealt = members.select(F.col("model").cast("int").alias("model"), "id", *(F.col(c).cast("double").alias(c) for c in x), F.col("y").cast("double").alias("y"))
    few = tasks <= FEW
    state = (dealt.repartition(tasks, "model") if few else dealt.repartition(tasks)).mapInArrow(begin, _STATE).checkpoint()
    recent: list[tuple] = []
    for tree in range(how.rounds):
        nodes = 2 << how.depth
        now = (np.full((len(seeds), nodes), -1, np.int64), np.zeros((len(seeds), nodes), np.int64), np.zeros((len(seeds), nodes)))
        for level in range(how.depth):
            if level and not (now[0][:, 1 << level - 1 : 1 << level] >= 0).any():
                break
            sums, choose = _histogram(how, width, list(recent), now, level, seeds, tree, grid), _choose(how, width, max(map(len, cuts)) + 1, level, seeds, tree)
            if few:
                part = state.mapInArrow(lambda batches, sums=sums, choose=choose: choose(sums(batches)), _SPLITS)
            else:
                part = state.mapInArrow(sums, _SUMS).repartition(min(tasks, len(seeds) << level), "model", "node").mapInArrow(choose, _SPLITS)
            _write(part.toArrow(), ens, now)  # models x nodes
        for store, part in zip((ens.feature, ens.bin, ens.value), now, strict=True):
            store.append(part)
        recent.append(now)
        if len(recent) == REBASE and tree + 1 < how.rounds:
            state, recent = state.mapInArrow(rebased(recent), _STATE).checkpoint(), []
    return ens


def predict(rows: DataFrame, ens: Ensembles) -> DataFrame:
    """rows (model int, x..., and more) with p, the probability of 1 by each row's model."""
    trees = list(zip(ens.feature, ens.bin, ens.value, strict=True))
    names = rows.columns

    def run(batches):
        for b in batches:
            model = b.column("model").to_numpy(zero_copy_only=False)
            margin = _grown(model, _binned(b, ens.x, ens.cuts), ens.base[model], trees, ens.how)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(1 / (1 + np.exp(-margin)))], names=[*names, "p"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, p double")


def bagged(rows: DataFrame, groups: list[str], folds: DataFrame, x: list[str], y: str, how: Boosting, members: int) -> tuple[DataFrame, Ensembles]:
    """Test rows of every fold with p, the mean over ``members`` seeds of trees fitted on that fold's training rows, and the fits.

    ``folds``: groups..., fold, train_to, test_from, test_to in the ``at`` of rows
    (groups..., at, id, x..., y): a few rows a group. Models are numbered by group, fold and seed.
    """
    known = folds.orderBy(*groups, "fold").collect()
    spark = rows.sparkSession
    plan = [(k * members + s, s + 1, *r) for k, r in enumerate(known) for s in range(members)]
    schema = "model int, seed int, " + ", ".join(f"`{n}` {t}" for n, t in folds.dtypes)
    models = F.broadcast(spark.createDataFrame(plan, schema))  # one row a model
    used = rows.select(*groups, "at", "id", *(F.col(c).cast("double").alias(c) for c in x), F.col(y).cast("double").alias("y")).join(models, groups)
    ens = fit(used.filter(F.col("at") < F.col("train_to")).select("model", "id", *x, "y"), x, how, [p[1] for p in plan])
    scored = predict(used.filter((F.col("at") >= F.col("test_from")) & (F.col("at") < F.col("test_to"))).select("model", *groups, "fold", "at", "id", *x, "y"), ens)
    return scored.groupBy(*groups, "fold", "at", "id", "y").agg(F.avg("p").alias("p")), ens
