"""Benchmark decontamination with a generalised suffix automaton (operator 8).

The normalised test items are put into one automaton over word ids. Training
words stream through it; at each word the automaton knows the longest run
ending there that some item holds, and the state tells which items. Every
window (13 words, or a shorter item whole) that occurs marks its words.

The benchmark is dealt into shards of about SHARD_WORDS words, whose automata
are built in tasks. The driver hands on one of them at a time and a task holds
one, however large the benchmark grows; each shard is a further pass in which
the rows take their marks along.
"""

from __future__ import annotations

import pickle
import uuid
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import textkit as tk

WINDOW = 13
#: Words of a shard, about.
SHARD_WORDS = 100_000
#: A document is contaminated if n_hit * COVERAGE >= n_words.
COVERAGE = 20


class Automaton:
    """Generalised suffix automaton of items; states are indices into parallel lists."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        vocab = self.vocab = {w: k for k, w in enumerate(sorted({w for _, words in items for w in words}))}
        self.names = [name for name, _ in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[int]] = [set()]
        coded = [[vocab[w] for w in words] for _, words in items]
        for item, code in enumerate(coded):
            last = 0
            for w in code:
                last = self._extend(last, w, ends)
                ends[last].add(item)
        order = sorted(range(1, len(self.link)), key=lambda v: -self.length[v])
        for v in order:  # a state's strings end wherever those of the states below it do
            if self.length[self.link[v]] >= window:
                ends[self.link[v]] |= ends[v]
        self.items = [frozenset(e if n >= window else ()) for e, n in zip(ends, self.length, strict=True)]
        self.short: list[list[tuple[int, int]]] = [[] for _ in self.link]
        for item, code in enumerate(coded):
            if len(code) < window:
                v = 0
                for w in code:
                    v = self.next[v][w]
                self.short[v].append((len(code), item))
        self.out = [-1] * len(self.link)  # the next state up the links at which a short item ends
        for v in reversed(order):
            p = self.link[v]
            self.out[v] = p if self.short[p] else self.out[p]
        self.least = min([min(len(c), window) for c in coded], default=window)

    def _extend(self, last: int, w: int, ends: list) -> int:
        nxt, link, length = self.next, self.link, self.length

        def clone(p: int, q: int) -> int:
            c = len(link)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            ends.append(set())
            link[q] = c
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = c
                p = link[p]
            return c

        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else clone(last, q)
        cur = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        ends.append(set())
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else clone(p, q)
        return cur

    def stream(self, words: list[int], spans: list[tuple[int, int]], found: set[int], at: int) -> None:
        """Match words (vocabulary ids); add spans of hit words, counted from ``at``, and the items they come from."""
        v = n = 0
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for i, w in enumerate(words, at + 1):
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            if w in nxt[v]:
                v = nxt[v][w]
                n += 1
            if n >= window:
                while length[link[v]] >= window:  # the state of the last ``window`` words
                    v = link[v]
                n = min(n, length[v])
                spans.append((i - window, i))
                found |= self.items[v]
            u = v if self.short[v] else self.out[v]
            while u > 0:
                for size, item in self.short[u]:
                    if size <= n:
                        spans.append((i - size, i))
                        found.add(item)
                u = self.out[u]


def _coded(buf: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of all rows, the number of each word among them, and n+1 offsets of rows among the words."""
    buf = tk.LOWER[buf]
    start, end, rows = tk.words(buf, offsets, tk.ALNUM)
    coded = tk.word_array(buf, start, end).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), rows


def _measure(batches):
    for piece in tk.slices(batches):
        buf, offsets = tk.utf8(piece.column("text"))
        _, _, rows = tk.words(tk.LOWER[buf], offsets, tk.ALNUM)
        yield pa.RecordBatch.from_arrays([piece.column("item_id").combine_chunks(), pa.array(np.diff(rows))], names=["item_id", "n"])


def _build(window: int):
    def run(table: pa.Table) -> pa.Table:
        names, at, rows = _coded(*tk.utf8(table.column("text")))
        items = [(i, [names[w] for w in at[rows[k] : rows[k + 1]]]) for k, i in enumerate(table.column("item_id").to_pylist())]
        built = Automaton([x for x in items if x[1]], window)
        return pa.table({"shard": table.column("shard").slice(0, 1), "automaton": pa.array([pickle.dumps(built)], pa.binary())})

    return run


def shards(benchmark: DataFrame, work: tk.Workspace, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, int]:
    """Pickled automata (shard, automaton) of about ``shard_words`` words each, built in tasks, and their number."""
    ids = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    words = ids.mapInArrow(_measure, "item_id string, n long").agg(F.sum("n")).first()[0] or 0
    n = max(1, -(-words // shard_words))
    dealt = ids.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int"))
    return work.save(dealt.groupBy("shard").applyInArrow(_build(window), "shard int, automaton binary"), "shards"), n


_held: dict[str, Automaton] = {}


def _automaton(shared, name: str) -> Automaton:
    """The automaton of a broadcast, unpickled once by a worker; the one before is let go."""
    if name not in _held:
        _held.clear()
        _held[name] = pickle.loads(shared.value)
    return _held[name]


_FOUND_SO_FAR = "_n long, _from array<long>, _to array<long>, _items array<string>"


def _scan(docs: DataFrame, pickled: bytes) -> DataFrame:
    """Per row: _n words, hit spans in words (merged, ascending) and the ids of the items found, with those of earlier shards."""
    shared = docs.sparkSession.sparkContext.broadcast(pickled)  # one shard: bounded by SHARD_WORDS
    name = uuid.uuid4().hex
    before = "_from" in docs.columns
    keep = [c for c in docs.columns if c not in ("_n", "_from", "_to", "_items")]

    def run(batches):
        sa = _automaton(shared, name)
        for piece in tk.slices(batches):
            buf, offsets = tk.utf8(piece.column("text"))
            names, at, rows = _coded(buf, offsets)
            spots = np.array([sa.vocab.get(w, -1) for w in names], np.int64)[at]
            known = spots >= 0
            edge = np.zeros(len(spots) + 1, bool)
            edge[rows] = True
            runs = np.flatnonzero(known & (edge[:-1] | ~np.append(False, known[:-1])))
            stops = np.flatnonzero(known & (edge[1:] | ~np.append(known[1:], False))) + 1
            long = stops - runs >= sa.least  # shorter runs of known words hold no window
            spans: list[list[tuple[int, int]]] = [[] for _ in range(len(rows) - 1)]
            found: list[set[str]] = [set() for _ in spans]
            if before:
                spans = [list(zip(a, b, strict=True)) for a, b in zip(piece.column("_from").to_pylist(), piece.column("_to").to_pylist(), strict=True)]
                found = [set(x) for x in piece.column("_items").to_pylist()]
            for a, b in zip(runs[long], stops[long], strict=True):
                r = int(np.searchsorted(rows, a, "right")) - 1
                items: set[int] = set()
                sa.stream(spots[a:b].tolist(), spans[r], items, int(a - rows[r]))
                found[r] |= {sa.names[k] for k in items}
            starts, ends = zip(*map(_merge, spans), strict=True) if spans else ((), ())
            cols = [pa.array(np.diff(rows)), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array([sorted(f) for f in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(piece.column(c).combine_chunks() for c in keep), *cols], names=[*keep, "_n", "_from", "_to", "_items"])

    return docs.mapInArrow(run, tk.extended(docs.select(keep), _FOUND_SO_FAR))


def _merge(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(b, ends[-1])
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


_SPANS = pa.list_(pa.int64())


def _cut(texts: pa.Array, hit: np.ndarray, starts: list, ends: list) -> pa.Array:
    """texts with the words of the spans of rows ``hit`` cut out.

    A span goes with the separators behind its last word if a word follows, so its neighbours stay apart.
    """
    parts, done = [], 0
    for r in hit.tolist():
        buf, offsets = tk.utf8(texts.slice(r, 1))
        first, last, _ = tk.words(tk.LOWER[buf], offsets, tk.ALNUM)
        at, left = 0, []
        for a, b in zip(starts[r], ends[r], strict=True):
            left.append(buf[at : first[a]])
            at = first[b] if b < len(first) else last[b - 1]
        text = np.concatenate([*left, buf[at:]]).tobytes().decode()
        parts += [texts.slice(done, r - done), pa.array([text], texts.type)]
        done = r + 1
    return pa.concat_arrays([*parts, texts.slice(done)])


def _settle(batches, cut: bool = False):
    """Count, hash and judge what all shards found; on demand cut the spans out of rows that are not contaminated."""
    for batch in batches:
        names = [n for n in batch.schema.names if n not in ("_from", "_to", "_items", "_n")]
        starts, ends, items = (batch.column(c).to_pylist() for c in ("_from", "_to", "_items"))
        n = batch.column("_n").to_numpy()
        hit = np.array([sum(e) - sum(s) for s, e in zip(starts, ends, strict=True)], np.int64)
        cols = [pa.array(n), pa.array(hit), pa.array([len(i) for i in items], pa.int64()), pa.array([sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()), pa.array((hit > 0) & (COVERAGE * hit >= n)), pa.array(starts, _SPANS), pa.array(ends, _SPANS)]
        kept = [batch.column(c) for c in names]
        if cut:
            at = names.index("text")
            kept[at] = _cut(kept[at], np.flatnonzero((hit > 0) & (COVERAGE * hit < n)), starts, ends)
        yield pa.RecordBatch.from_arrays([*kept, *cols], names=[*names, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_from", "hit_to"])


_FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_from array<long>, hit_to array<long>"


def _found(own: DataFrame, benchmark: DataFrame, window: int, shard_words: int, cut: bool) -> DataFrame:
    """own (see ``textkit.aside``) with the columns of _FOUND. Each shard is one pass; between passes the rows are written, so one automaton at a time is held."""
    work = tk.Workspace(own.sparkSession, "decontaminate")
    built, n = shards(benchmark, work, window, shard_words)
    for k in range(n):
        row = built.filter(F.col("shard") == k).first()
        found = _scan(own if not k else found, row["automaton"] if row else pickle.dumps(Automaton([], window)))
        if k < n - 1:
            found = work.save(found, f"pass-{k}")
            work.drop(f"pass-{k - 1}")
    work.drop("shards")
    return found.mapInArrow(partial(_settle, cut=cut), tk.extended(own, _FOUND))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, cut: bool = False) -> DataFrame:
    """Every row of docs with n_words, n_hit, n_items, items_sha256, contaminated, hit_from and hit_to, in place of columns of those names.

    The hit spans count words from 0 and exclude their end. Null texts have no
    words; an empty benchmark hits nothing; items with equal ids count once, a null id as an empty one.
    With ``cut`` the spans go out of the text of rows that are not contaminated.
    """
    more = [c.split()[0] for c in _FOUND.split(", ")]
    own, back = tk.aside(docs.drop(*more), "text")
    return _found(own, benchmark, window, shard_words, cut).select(*back, *more)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    """``find`` in all documents; a null text has no words and no hit."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that the coverage rule does not call contaminated, with all their columns, without the benchmark spans in their text."""
    own, back = tk.aside(docs, "text")
    return _found(own, benchmark, WINDOW, SHARD_WORDS, True).filter(~F.col("contaminated")).select(back)


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, s.size, i, array_to_string(w[i : i + s.size - 1], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT size FROM bw) s WHERE i + s.size - 1 <= len(w)),
m AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
