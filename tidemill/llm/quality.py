"""Document quality by a linear-chain conditional random field over lines (operator 3).

Each line is good or bad, judged by its own features and those of its
neighbours, and neighbouring labels pull on one another. Forward-backward
gives each line's probability of being good; their mean, weighted by length,
is the document's score. Labels exist for documents only: a labelled document
lends its label to all its lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm import textkit as tk
from tidemill.llm.labelled import fold, sample

#: Labelled rows the field is fitted on, at most; of each, all lines.
SAMPLE_ROWS = 5_000
#: In the fit a longer chain is cut into pieces of so many lines, which keep their neighbours' features (piecewise training); documents are scored as one chain.
PIECE = 64
STEPS, RATE, DECAY = 250, 0.05, 1e-3
#: Lines of the labelled rows together, at most (features take some 600 bytes a line in the fit).
SAMPLE_LINES = 250_000
#: Lines and bytes whose features are held at once, and lines that the forward and backward passes of a score hold at once.
BLOCK, BLOCK_BYTES, SEGMENT = 1 << 14, 1 << 20, 1 << 18

_CLASSES = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "stop": b".,;:?'\"()-",
    "shout": b"!",
    "symbol": b"#$%&*+/<=>@\\^_`{}~[]",
    "pipe": b"|",
    "blank": b" \t\r\x0b\x0c",
    "wide": range(0x80, 0x100),
}
_MEMBERS = np.zeros((256, len(_CLASSES)), np.float32)
for _k, _members in enumerate(_CLASSES.values()):
    _MEMBERS[list(_members), _k] = 1
OWN = len(_CLASSES) + 6


def bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of lines, and the n+1 offsets of rows among the lines; every row has one line at least."""
    breaks = np.flatnonzero(buf == 10)
    row = np.searchsorted(offsets[1:], breaks, "right")
    start = np.sort(np.concatenate([offsets[:-1] * 2, breaks * 2 + 1])) // 2  # a row's first line starts at its offset, others behind a break
    first = np.arange(len(offsets) - 1) + np.searchsorted(row, np.arange(len(offsets) - 1))
    is_break = np.ones(len(start), bool)
    is_break[first] = False
    begin = start + is_break
    end = np.append(start[1:], offsets[-1])
    end[np.append(first[1:], len(start)) - 1] = offsets[1:]
    return begin, end, np.append(first, len(begin))


def own_features(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Features (n, OWN) of consecutive lines, each by itself."""
    buf, begin, end = buf[begin[0] : end[-1]], begin - begin[0], end - begin[0]
    size = end - begin
    counts = np.empty((len(begin), _MEMBERS.shape[1]))
    for k in range(_MEMBERS.shape[1]):
        sums = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(_MEMBERS[:, k][buf], out=sums[1:])
        counts[:, k] = sums[end] - sums[begin]
    share = counts / np.maximum(size, 1)[:, None]
    ws, we, _ = tk.words(buf, np.append(begin, len(buf)), tk.NOT_BLANK)
    codes = tk.word_hashes(buf, ws, we)
    line = np.searchsorted(begin, ws, "right") - 1
    n = np.bincount(line, minlength=len(begin))
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (line[1:] == line[:-1])
    width = np.bincount(line, we - ws, len(begin))
    solid = np.maximum(n, 1)
    more = [np.log1p(size) / 8, np.log1p(n) / 5, width / solid / 10, np.bincount(line, again, len(begin)) / solid, (size == 0).astype(float), (counts[:, 0] > counts[:, 1]).astype(float)]
    return np.concatenate([share, np.stack(more, 1)], 1).astype(np.float32)


def blocks(begin: np.ndarray, end: np.ndarray):
    """Ranges of lines, each of at most BLOCK lines and about BLOCK_BYTES (a longer line comes alone)."""
    at = 0
    while at < len(begin):
        to = min(at + BLOCK, max(at + 1, int(np.searchsorted(end, begin[at] + BLOCK_BYTES, "right"))))
        yield at, to
        at = to


def lines(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (n_lines, OWN), lengths in bytes, and the n+1 offsets of rows among the lines."""
    begin, end, rows = bounds(buf, offsets)
    found = [own_features(buf, begin[a:b], end[a:b]) for a, b in blocks(begin, end)]
    return np.concatenate(found) if found else np.zeros((0, OWN), np.float32), end - begin, rows


def with_neighbours(own: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and the line after (0 at the ends), two marks of an end, and a constant."""
    edge = np.zeros((len(own), 2), np.float32)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    heads, tails = rows[:-1], rows[1:] - 1
    before[heads], after[tails] = 0, 0
    edge[heads, 0], edge[tails, 1] = 1, 1
    return np.concatenate([own, before, after, edge, np.ones((len(own), 1), np.float32)], 1)


class Field:
    """``unary`` weighs features towards good; ``pair[a, b]`` scores label b behind label a (0 bad, 1 good)."""

    def __init__(self, mean=None, std=None):
        self.mean, self.std = mean, std
        self.unary, self.pair = np.zeros(3 * OWN + 3), np.zeros((2, 2))

    def features(self, own: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return with_neighbours((own - self.mean) / self.std, rows) if self.mean is not None else with_neighbours(own, rows)

    def marginals(self, x: np.ndarray, rows: np.ndarray):
        """P(good) of each line, and the expected label pairs; all chains advance together, longest first."""
        u = (x @ self.unary).astype(float)
        size = np.diff(rows)
        order = np.argsort(-size, kind="stable")
        size, base = size[order], rows[:-1][order]
        active = len(size) - np.searchsorted(size[::-1], np.arange(size[0] if len(size) else 0), "right")
        e = np.exp(self.pair - self.pair.max())
        local = np.stack([1 / (1 + np.exp(np.clip(u, -500, 500))), 1 / (1 + np.exp(np.clip(-u, -500, 500)))], 1)
        ahead = np.zeros((len(u), 2))
        norm = np.ones(len(u))
        for t, m in enumerate(active):
            at = base[:m] + t
            a = local[at] if t == 0 else (ahead[at - 1] @ e) * local[at]
            norm[at] = a.sum(1)
            ahead[at] = a / norm[at][:, None]
        back = np.ones((len(u), 2))
        pairs = np.zeros((2, 2))
        for t in range(len(active) - 2, -1, -1):
            m = active[t + 1]
            at = base[:m] + t
            w = local[at + 1] * back[at + 1] / norm[at + 1][:, None]
            pairs += (ahead[at].T @ w) * e
            back[at] = w @ e.T
        p = ahead * back
        return p[:, 1] / p.sum(1), pairs

    def unaries(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The weight of each line's features towards good, block by block; a block's features take in a line on either side."""
        u = np.empty(len(begin))
        for a, b in blocks(begin, end):
            a1, b1 = max(a - 1, 0), min(b + 1, len(begin))
            inner = rows[np.searchsorted(rows, a1, "right") : np.searchsorted(rows, b1)]  # rows that begin inside
            x = self.features(own_features(buf, begin[a1:b1], end[a1:b1]), np.concatenate([[a1], inner, [b1]]) - a1)
            u[a:b] = x[a - a1 : b - a1] @ self.unary
        return u

    def chained(self, u: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """P(good) of each line from its unary weight: the same as ``marginals``, with the lines as one product of 2x2 matrices.

        A row's first line forgets what came before. The product is taken over runs of
        about the root of a segment's lines side by side, so one long text costs no more
        steps than many short ones; of a segment only the states at its ends are carried.
        """
        n = len(u)
        head = np.zeros(n, bool)
        head[rows[:-1]] = True
        e = np.exp(self.pair - self.pair.max())
        cuts = list(range(0, n, SEGMENT)) + [n]

        def matrices(a: int, b: int) -> np.ndarray:
            """(steps, runs, 2, 2): line a + run * steps + step; behind the last the identity."""
            local = np.stack([1 / (1 + np.exp(np.clip(u[a:b], -500, 500))), 1 / (1 + np.exp(np.clip(-u[a:b], -500, 500)))], 1)
            m = np.where(head[a:b, None, None], 1.0, e[None]) * local[:, None, :]
            steps = max(1, int(np.sqrt(b - a)))
            runs = -(-(b - a) // steps)
            m = np.concatenate([m, np.broadcast_to(np.eye(2), (steps * runs - (b - a), 2, 2))])
            return m.reshape(runs, steps, 2, 2).transpose(1, 0, 2, 3)

        def products(m: np.ndarray) -> np.ndarray:
            t = np.broadcast_to(np.eye(2), m.shape[1:])
            for x in m:
                t = t @ x
                t = t / t.sum((1, 2), keepdims=True)
            return t

        totals, heads, state = [], [], np.array([0.5, 0.5])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            totals.append(products(matrices(a, b)))
            starts = np.empty((len(totals[-1]), 2))
            for k, t in enumerate(totals[-1]):
                starts[k] = state
                state = state @ t
                state = state / state.sum()
            heads.append(starts)
        p, back = np.empty(n), np.array([0.5, 0.5])
        for k in range(len(cuts) - 2, -1, -1):
            a, b = cuts[k], cuts[k + 1]
            m, t = matrices(a, b), totals[k]
            ends = np.empty((len(t), 2))
            for j in range(len(t) - 1, -1, -1):
                ends[j] = back
                back = t[j] @ back
                back = back / back.sum()
            ahead = np.empty((*m.shape[:2], 2))
            f = heads[k]
            for j, x in enumerate(m):
                f = (f[:, None, :] @ x)[:, 0]
                f = f / f.sum(1, keepdims=True)
                ahead[j] = f
            g = ends
            for j in range(len(m) - 1, -1, -1):
                ahead[j] *= g
                g = (m[j] @ g[:, :, None])[:, :, 0]
                g = g / g.sum(1, keepdims=True)
            both = ahead.transpose(1, 0, 2).reshape(-1, 2)[: b - a]
            p[a:b] = both[:, 1] / both.sum(1)
        return p

    def fit(self, own: list[np.ndarray], labels: np.ndarray) -> Field:
        if not own:
            return self
        rows = np.concatenate([[0], np.cumsum([len(x) for x in own])])
        flat = np.concatenate(own).astype(float)
        self.mean, self.std = flat.mean(0), flat.std(0) + 1e-3
        x = self.features(flat, rows)
        y = np.repeat(labels, np.diff(rows)).astype(float)
        n = len(labels)
        rows = np.concatenate([*(np.arange(a, b, PIECE) for a, b in zip(rows[:-1], rows[1:], strict=True)), rows[-1:]])
        links, good = (np.diff(rows) - 1).astype(float), y[rows[:-1]]
        truth = np.diag([links[good == 0].sum(), links[good == 1].sum()])
        theta = np.concatenate([self.unary, self.pair.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            p, pairs = self.marginals(x, rows)
            grad = np.concatenate([x.T @ (p - y) / n, (pairs - truth).ravel() / n]) + DECAY * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            self.unary, self.pair = theta[:-4], theta[-4:].reshape(2, 2)
        return self


def _gather(batches):
    for piece in tk.slices(batches):
        own, _, rows = lines(*tk.utf8(piece.column("text")))
        used = [own[a:b].ravel() for a, b in zip(rows[:-1], rows[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([piece.column("label").combine_chunks(), pa.array(used, pa.list_(pa.float32()))], names=["label", "own"])


def fit(docs: DataFrame, labels: DataFrame, learn, rows: int = SAMPLE_ROWS, most: int = SAMPLE_LINES) -> Field:
    """Fit on at most ``rows`` labelled documents of at most ``most`` lines together, of which only line features come to the driver; copies count once.

    A null or empty text is one empty line; null labels teach nothing; without labelled rows every line scores one half.
    """
    with tk.Workspace(docs.sparkSession, "quality") as work:
        drawn = sample(docs, labels, "quality", learn, rows, work, lines=most).mapInArrow(_gather, "label int, own array<float>").toArrow().combine_chunks()
    if not drawn.num_rows:
        return Field()
    texts = [np.asarray(x.values, np.float32) for x in drawn.column("own").combine_chunks()]
    once = {(t.tobytes(), int(y)): k for k, (t, y) in enumerate(zip(texts, drawn.column("label").to_pylist(), strict=True))}
    keys = sorted(once)  # the order of arrival must not matter
    return Field().fit([texts[once[k]].reshape(-1, OWN) for k in keys], np.array([y for _, y in keys]))


def score(docs: DataFrame, field: Field) -> DataFrame:
    """Add score (0 to 1) and predicted to every row, in place of columns of those names; a null or empty text is one empty line."""
    docs = docs.drop("score", "predicted")
    keep = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for piece in tk.slices(batches):
            buf, offsets = tk.utf8(piece.column("text"))
            begin, end, rows = bounds(buf, offsets)
            good = shared.value.chained(shared.value.unaries(buf, begin, end, rows), rows)
            weight = end - begin + 1e-6
            s = np.clip(tk.segment_sum(good * weight, rows) / tk.segment_sum(weight, rows), 0, 1)
            yield pa.RecordBatch.from_arrays([*(piece.column(c).combine_chunks() for c in keep), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.mapInArrow(run, tk.extended(docs, "score double, predicted int"))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """``score`` of all documents by a field that has not seen the held-out labels; null texts count as empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = fit(docs, labels, ~fold(3, 1))
    return score(docs, field).select("doc_id", fold(3, 1).alias("held_out"), "score", "predicted")
