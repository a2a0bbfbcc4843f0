"""Target-distribution importance resampling by partition-local word tries (operator 11).

A feature is a run of up to RUN consecutive words. Each task grows a trie of
the runs it meets: a node has its feature's count and CRC state, so the CRC of
a longer run continues from its parent. The counts go to buckets, the features'
CRCs modulo BUCKETS, and bucket totals merge by addition; a trie that has grown
to MOST_NODES hands over its counts and starts afresh, which changes no total.
To score, a task walks the same tries with each bucket's gain on its nodes.

Scores are perturbed by Gumbel noise of the document id, so the highest ones
are a draw without replacement. Whole scores take a bounded number of values:
their histogram gives every score the rank at which it begins.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import textkit as tk

#: Words of the longest feature; buckets; least words of a document that may be drawn; percent drawn; seed.
RUN, BUCKETS, MIN_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Nodes of a task's trie, about.
MOST_NODES = 1 << 19


class Trie:
    """Runs of words; node 0 is the root. ``gains``, if given, are put on the nodes."""

    def __init__(self, run: int, gains: np.ndarray | None = None):
        self.run, self.gains = run, gains
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, bytes], int] = {}
        self.state = [0]
        self.count = np.zeros(1024, np.int64)
        self.gain: list[int] = [0]

    def __len__(self) -> int:
        return len(self.state)

    def _node(self, parent: int, word: bytes) -> int:
        node = self.child.get((parent, word))
        if node is None:
            node = self.child[parent, word] = len(self.state)
            state = zlib.crc32(b" " + word, self.state[parent]) if parent else zlib.crc32(word)
            self.state.append(state)
            if self.gains is not None:
                self.gain.append(int(self.gains[state % BUCKETS]))
        return node

    def walk(self, buf: np.ndarray, offsets: np.ndarray):
        """Nodes of the runs of 1, 2, ... words from each word of each row, and the rows' n+1 offsets among the words; a run that would leave its row is at the root."""
        buf = tk.LOWER[buf]
        start, end, rows = tk.words(buf, offsets, tk.ALNUM)
        coded = tk.word_array(buf, start, end).dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        left = np.repeat(rows[1:], np.diff(rows)) - np.arange(len(at))
        levels, nodes = [], np.zeros(len(at), np.int64)
        for k in range(self.run):
            whole = np.flatnonzero(left > k)
            paths, back = np.unique(nodes[whole] * len(words) + at[whole + k], return_inverse=True)
            found = np.array([self._node(p, words[w]) for p, w in zip(*(x.tolist() for x in divmod(paths, max(1, len(words)))), strict=True)], np.int64)
            nodes = np.zeros(len(at), np.int64)
            nodes[whole] = found[back]
            levels.append(nodes)
        return levels, rows

    def add(self, buf: np.ndarray, offsets: np.ndarray) -> None:
        levels, _ = self.walk(buf, offsets)
        if len(self.count) < len(self):
            self.count = np.append(self.count, np.zeros(len(self), np.int64))
        for nodes in levels:
            seen = np.bincount(nodes, minlength=1)
            seen[0] = 0
            self.count[: len(seen)] += seen

    def totals(self) -> np.ndarray:
        """Features of each bucket."""
        out = np.zeros(BUCKETS, np.int64)
        np.add.at(out, np.array(self.state, np.int64)[1:] % BUCKETS, self.count[1 : len(self)])
        return out


def bucket_counts(texts: DataFrame, run: int = RUN) -> np.ndarray:
    """Features of each bucket in all texts (column text; null has none)."""

    def count(batches):
        trie, held = Trie(run), np.zeros(BUCKETS, np.int64)
        for piece in tk.slices(batches):
            trie.add(*tk.utf8(piece.column("text")))
            if len(trie) > MOST_NODES:
                held += trie.totals()
                trie.clear()
        held += trie.totals()
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of each bucket's smoothed shares."""
    s, t = int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + BUCKETS) / ((a + 1) * (t + BUCKETS)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, run: int = RUN) -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean gain) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain.tobytes())  # BUCKETS longs
    names = ["doc_id", "n_words", "n_features", "weight"]

    def score(batches):
        trie = Trie(run, np.frombuffer(shared.value, np.int64))
        for piece in tk.slices(batches):
            levels, rows = trie.walk(*tk.utf8(piece.column("text")))
            on = np.array(trie.gain, np.int64)
            total = sum(tk.segment_sum(on[nodes], rows, np.int64) for nodes in levels)
            n = sum(tk.segment_sum((nodes > 0).astype(np.int64), rows, np.int64) for nodes in levels)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").combine_chunks(), *(pa.array(x) for x in (np.diff(rows), n, weight))], names=names)
            if len(trie) > MOST_NODES:
                trie.clear()

    return docs.select("doc_id", "text").mapInArrow(score, ", ".join(f"{n} long" for n in names))


def perturbed(doc_id, seed: int):
    """floor(1000 * Gumbel noise) of a document; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_features, weight, score and rank (of those drawn; else null).

    ``target`` (text) is what the draw should resemble. Null and empty texts have
    no features, weight 0, and are not drawn. Repeated ids, which have the same
    noise, tie; a null id counts as least. Empty tables give no rows or, as
    target, equal counts. Other columns are left out.
    """
    with tk.Workspace(docs.sparkSession, "resample") as work:
        return work.keep(_resample(docs.select("doc_id", "text"), target, run, min_words, percent, seed, work))


def _resample(docs: DataFrame, target: DataFrame, run: int, min_words: int, percent: int, seed: int, work: tk.Workspace) -> DataFrame:
    gain = gains(bucket_counts(docs, run), bucket_counts(target, run))
    scored = work.save(weigh(docs, gain, run).withColumn("score", F.col("weight") + perturbed(F.col("doc_id"), seed)), "scored")
    # A weight lies between the gains, a few tens of thousands at most, and noise within (-3200, 23000): the histogram is bounded, whatever the table.
    hist = sorted(((r.score, r.n) for r in scored.filter(F.col("n_words") >= min_words).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    drawn = percent * sum(n for _, n in hist) // 100
    begins, before = [], 0
    for value, n in hist:
        if before >= drawn:
            break
        begins.append((value, before))
        before += n
    begins = F.broadcast(docs.sparkSession.createDataFrame(begins, "score long, _before long"))
    out = scored.join(begins, "score", "left").withColumn("_in", F.col("_before").isNotNull() & (F.col("n_words") >= min_words))
    columns = ["doc_id", "n_features", "weight", "score"]
    place = F.expr("_before + row_number() OVER (PARTITION BY score ORDER BY doc_id)")  # a score's rows: at most about one in 2700, by the noise
    ranked = out.filter("_in").select(*columns, place.alias("rank"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(out.filter("NOT _in").select(*columns, F.lit(None).cast("long").alias("rank")))


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    """``resample`` of all documents towards the benchmark."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
v AS (SELECT DISTINCT unnest(w) AS f FROM (SELECT w FROM d UNION ALL SELECT w FROM b)),
tab AS (
  SELECT list(list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), n) ORDER BY n) AS tab
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n)),
bytes AS (SELECT f, list_transform(range(0, CAST(length(hex(f)) AS BIGINT), 2), lambda i: CAST('0x' || substr(hex(f), i + 1, 2) AS BIGINT)) AS b FROM v),
code AS (
  SELECT f, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT))) % {BUCKETS} AS bucket
  FROM bytes, tab),
df AS (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(w) AS f FROM d) GROUP BY doc_id, f),
src AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS s FROM df JOIN code USING (f) GROUP BY bucket),
tgt AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(w) AS f FROM b) JOIN code USING (f) GROUP BY bucket),
tot AS (SELECT coalesce((SELECT sum(s) FROM src), 0)::DOUBLE AS s, coalesce((SELECT sum(t) FROM tgt), 0)::DOUBLE AS t),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(tgt.t, 0) + 1)::DOUBLE * (tot.s + {BUCKETS}) / ((src.s + 1)::DOUBLE * (tot.t + {BUCKETS})))) AS gain
  FROM src LEFT JOIN tgt USING (bucket), tot),
weight AS (SELECT doc_id, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM df JOIN code USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weight USING (doc_id)),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN (SELECT doc_id, rank FROM ranked WHERE rank <= {PERCENT} * n // 100) USING (doc_id)
"""
