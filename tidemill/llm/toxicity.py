"""Toxicity by a factorization machine over hashed terms (operator 2).

Terms are the lower-cased words of a text and their first four bytes, hashed.
The machine adds a weight for each term present and, for each pair of them,
the product of their factor vectors, so that an insult beside a mention of a
group can weigh more than both alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import textkit as tk
from tidemill.llm.labelled import fold, sample

#: Labelled rows the machine is fitted on, at most.
SAMPLE_ROWS = 12_000
#: Hashed terms, factors a term, and the sampled documents that must hold a term for it to count.
HASH_BITS, FACTORS, MIN_DOCS = 18, 6, 10
EPOCHS, BATCH, RATE, DECAY = 15, 256, 0.03, 1e-4


def terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of all rows, distinct and ascending in each, and the n+1 offsets of the rows."""
    buf = tk.LOWER[buf]
    start, end, rows = tk.words(buf, offsets, tk.ALNUM)
    sums = tk.prefix(buf.astype(np.uint64) + np.uint64(1))
    head = np.minimum(end, start + 4)
    shift = np.uint64(64 - HASH_BITS)
    whole = tk.ranges(sums, start, end) >> shift
    stem = tk.mix(tk.ranges(sums, start, head)) >> shift
    row = np.repeat(np.arange(len(rows) - 1, dtype=np.uint64), np.diff(rows)) << np.uint64(HASH_BITS)
    both = np.unique(np.concatenate([row | whole, row | stem]))
    return (both & np.uint64((1 << HASH_BITS) - 1)).astype(np.int32), np.searchsorted(both, np.arange(len(rows), dtype=np.uint64) << np.uint64(HASH_BITS))


class FactorizationMachine:
    def __init__(self):
        self.place = np.full(1 << HASH_BITS, -1, np.int32)  # of a hashed term among the weights
        self.bias, self.weight, self.factor = 0.0, np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32)

    def fit(self, rows: list[np.ndarray], labels: np.ndarray) -> FactorizationMachine:
        if not len(labels):
            return self
        held = np.bincount(np.concatenate(rows), minlength=1 << HASH_BITS)
        kept = np.flatnonzero(held >= MIN_DOCS)
        self.place[kept] = np.arange(len(kept))
        n = len(kept)
        rng = np.random.default_rng(2)
        theta = np.concatenate([np.zeros((n, 1)), rng.normal(0, 0.01, (n, FACTORS))], 1)
        coded = [p[p >= 0] for p in (self.place[r] for r in rows)]
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        bias = float(np.log(share / (1 - share)))
        square, bias_square = np.full_like(theta, 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                ids = np.concatenate([coded[k] for k in pick])
                bounds = np.concatenate([[0], np.cumsum([len(coded[k]) for k in pick])])
                v = theta[ids]
                total = tk.segment_sum(v[:, 1:], bounds)
                score = bias + tk.segment_sum(v[:, 0], bounds) + (total**2 - tk.segment_sum(v[:, 1:] ** 2, bounds)).sum(1) / 2
                slope = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[pick]
                each = np.repeat(slope, np.diff(bounds))[:, None]
                local = each * np.concatenate([np.ones((len(ids), 1)), np.repeat(total, np.diff(bounds), axis=0) - v[:, 1:]], 1)
                unique, inverse = np.unique(ids, return_inverse=True)
                grad = np.stack([np.bincount(inverse, local[:, f], len(unique)) for f in range(1 + FACTORS)], 1) / len(pick) + DECAY * theta[unique]
                square[unique] += grad**2
                theta[unique] -= RATE * 4 * grad / np.sqrt(square[unique])
                bias_square += slope.mean() ** 2
                bias -= RATE * slope.mean() / bias_square**0.5
        self.bias, self.weight, self.factor = bias, theta[:, 0].astype(np.float32), theta[:, 1:].astype(np.float32)
        return self

    def score(self, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of hashed terms."""
        place = self.place[ids]
        known = place >= 0
        bounds = np.concatenate([[0], np.cumsum(known)])[rows]
        v = self.factor[place[known]]
        total = tk.segment_sum(v, bounds)
        z = self.bias + tk.segment_sum(self.weight[place[known]], bounds) + (total**2 - tk.segment_sum(v**2, bounds)).sum(1) / 2
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _gather(batches):
    for piece in tk.slices(batches):
        ids, rows = terms(*tk.utf8(piece.column("text")))
        yield pa.RecordBatch.from_arrays([piece.column("label").combine_chunks(), pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids, pa.int32()))], names=["label", "terms"])


def fit(docs: DataFrame, labels: DataFrame, learn, rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """Fit on at most ``rows`` labelled documents, of which only the hashed terms come to the driver; copies count once.

    Null and empty texts have no terms; null labels teach nothing; without labelled rows every text scores one half.
    """
    with tk.Workspace(docs.sparkSession, "toxicity") as work:
        drawn = sample(docs, labels, "toxic", learn, rows, work).mapInArrow(_gather, "label int, terms array<int>").toArrow().combine_chunks()
    lists = drawn.column("terms").combine_chunks() if drawn.num_rows else None
    if lists is None:
        return FactorizationMachine()
    texts = [np.asarray(x.values, np.int32) for x in lists]
    once = {(t.tobytes(), int(y)): k for k, (t, y) in enumerate(zip(texts, drawn.column("label").to_pylist(), strict=True))}
    keys = sorted(once)  # the order of arrival must not matter
    return FactorizationMachine().fit([texts[once[k]] for k in keys], np.array([y for _, y in keys], float))


def score(docs: DataFrame, machine: FactorizationMachine) -> DataFrame:
    """Add score (0 to 1) and predicted to every row, in place of columns of those names; null and empty texts get the score of no terms."""
    docs = docs.drop("score", "predicted")
    keep = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for piece in tk.slices(batches):
            s = shared.value.score(*terms(*tk.utf8(piece.column("text"))))
            yield pa.RecordBatch.from_arrays([*(piece.column(c).combine_chunks() for c in keep), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.mapInArrow(run, tk.extended(docs, "score double, predicted int"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """``score`` of all documents by a machine that has not seen the held-out labels; null texts have no terms."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = fit(docs, labels, ~fold(5, 0))
    return score(docs, machine).select("doc_id", fold(5, 0).alias("held_out"), "score", "predicted")
