"""Repeated word windows by a log-structured fingerprint index (operator 5).

Documents arrive in batches. A window's fingerprint is the least hash among
its grams of GRAM words, so neighbouring windows share one, and the index holds
a fingerprint for every window of every document it was given: a list of
immutable runs, each with a batch's fingerprints per bucket, sorted, with the
chunk of texts they come from. A batch's fingerprints are merge-joined with all
runs; where one is met in another document, the words themselves are compared,
those of the older texts from the index's own copy. Runs are compacted into one
when FANOUT of them have gathered and another batch arrives.

The index lies in a folder and can be opened again by a later session.
"""

from __future__ import annotations

import json
import uuid
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import textkit as tk
from tidemill.llm.repeats import CHUNK_BYTES, COVERS, HOT, OFFERS, SEGMENTS, Chunks, Cut, Kind, Marks, Segments, buckets, covers, extremes, flat, grouped, identical, lists, nothing, offer, owners, pieces, send, spread, told, with_hot

#: Words of a window, and of a fingerprint's gram.
WINDOW, GRAM = 13, 4
#: Batches of a full run, and runs that are compacted.
BATCHES, FANOUT = 3, 2
#: Before any document's id: that of all older batches.
_EARLIER = -(1 << 63)


def _joined(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words buf[start : end], each with a space behind, and where each begins."""
    at, of = spread(start, end)
    data = np.append(buf, np.uint8(32))[at]
    data[at == end[of]] = 32
    size = end - start + 1
    return data, np.cumsum(size) - size


def _cut(buf: np.ndarray, offsets: np.ndarray) -> Cut:
    start, end, rows = tk.words(buf, offsets, tk.NOT_BLANK)
    sums = tk.prefix(tk.word_hashes(buf, start, end))
    grams = np.zeros(len(start), np.uint64)
    at = np.arange(max(0, len(start) - GRAM + 1))
    grams[: len(at)] = tk.ranges(sums, at, at + GRAM)
    data, left = _joined(buf, start, end)
    return Cut(grams, rows, data, left, left + end - start)


KIND = Kind(_cut, WINDOW, GRAM, tail=False)

_MET = "old boolean, bucket int, h array<long>, n array<int>, at array<int>, chunk int, shared array<long>, hot array<long>"
_RUN = "bucket int, h array<long>, n array<int>, at array<int>"


def _merge(hot: int):
    """Merge-join a bucket of a batch's fingerprints with the runs' rows of that bucket.

    Gives the batch's row of a new run (old is false), and to every chunk, of
    the batch or older, the fingerprints that another document holds too.
    """

    def run(table: pa.Table, runs: pa.Table) -> pa.Table:
        h, n, chunk = flat(table, "h").view(np.uint64), flat(table, "n").astype(np.int64), owners(table, "h", "chunk")
        if not len(h):
            return nothing(_MET)
        order, start = grouped(h)
        h, n, chunk = h[order], n[order], chunk[order]
        size = np.diff(np.append(start, len(h)))
        key, total = h[start], np.add.reduceat(np.abs(n), start)
        shared = (size > 1) | (np.maximum.reduceat(n, start) > 0)
        met = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k in range(runs.num_rows):
            row = runs.slice(k, 1)
            known, times, at = flat(row, "h").view(np.uint64), flat(row, "n").astype(np.int64), flat(row, "at")
            entry, of = spread(np.searchsorted(known, key, "left"), np.searchsorted(known, key, "right") - 1)
            np.add.at(total, of, np.abs(times[entry]))
            shared[of] = True
            met.append((of, at[entry]))
        of, older = map(np.concatenate, zip(*met, strict=True))
        many = shared & (total > hot)
        mine = np.repeat(shared, size)
        who = np.concatenate([np.repeat(np.arange(len(key)), size)[mine], of])
        answers = told(np.concatenate([chunk[mine], older]), key[who], many[who])
        bucket = table.column("bucket")[0].as_py()
        one = np.array([0, len(h)])
        new = {"bucket": pa.array([bucket], pa.int32()), "h": lists(h, one, pa.int64()), "n": lists(n, one, pa.int32()), "at": lists(chunk, one, pa.int32())}
        blank = nothing(_MET)
        columns = {}
        for f in blank.schema:
            a = new[f.name] if f.name in new else pa.nulls(1, f.type)
            b = answers.column(f.name) if f.name in answers.column_names else pa.nulls(answers.num_rows, f.type)
            columns[f.name] = pa.chunked_array([a, *(b.chunks if isinstance(b, pa.ChunkedArray) else [b])], f.type)
        columns["old"] = pa.array([False] + [True] * answers.num_rows)
        return pa.table(columns).combine_chunks()

    return run


def _compact(n: int):
    """Rows of all runs of a bucket as one, or as one for each of the buckets it is split into when the index has ``n`` of them."""

    def run(table: pa.Table) -> pa.Table:
        h, times, at = flat(table, "h").view(np.uint64), flat(table, "n"), flat(table, "at")
        order = np.lexsort((h, buckets(h, n)))
        own = buckets(h, n)[order]
        start = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
        bounds = np.append(start, len(own))
        return pa.table({"bucket": pa.array(own[start], pa.int32()), "h": lists(h[order], bounds, pa.int64()), "n": lists(times[order], bounds, pa.int32()), "at": lists(at[order], bounds, pa.int32())})

    return run


def _verify(first: int):
    """In a fingerprint's bucket: windows of the same words, with the least document that holds them, back to the chunks from ``first`` on.

    Segments of older chunks belong to documents before all others.
    """

    def run(table: pa.Table) -> pa.Table:
        got = Segments(table)
        old = got.chunk < first
        got.least, got.most = extremes(got.number, np.where(old, _EARLIER, got.lo), np.where(old, _EARLIER, got.hi))
        text, _ = spread(got.begin[got.one], got.begin[got.one] + got.size[got.one] - 1)
        buf = got.buf[text]
        size = got.size[got.one]
        start, end, rows = tk.words(buf, np.concatenate([[0], np.cumsum(size)]), tk.NOT_BLANK)
        word, what = spread(rows[:-1], rows[1:] - WINDOW)
        a, b = start[word], end[word + WINDOW - 1]
        window, _ = identical(buf, a, b - a, tk.ranges(tk.prefix(buf.astype(np.uint64) + np.uint64(1)), a, b))
        least, _ = extremes(window, got.least[what], got.least[what])
        doc = least[window]
        ok = got.most[what] > doc
        word, what, doc = word[ok], what[ok], doc[ok]
        new = np.append(True, (word[1:] != word[:-1] + 1) | (what[1:] != what[:-1]) | (doc[1:] != doc[:-1]))[: len(word)]
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(word))[: len(head)] - 1
        left = word[head] - rows[what[head]]
        return covers(got, what[head], left, word[tail] - rows[what[tail]] + WINDOW, doc[head], first)

    return run


_REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _remove(with_text: bool):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        marks, out = Marks(answers), []
        for piece, ids, buf, offsets in pieces(table):
            cut = _cut(buf, offsets)
            gone = marks.gone(KIND, cut, ids)
            kept, rows = ~gone, cut.rows
            size = cut.right - cut.left + 1
            at, _ = spread(cut.left[kept], cut.right[kept])  # each word and the space behind it
            data = cut.data[at]
            ends = np.concatenate([[0], np.cumsum(size[kept])])[np.concatenate([[0], np.cumsum(kept)])[rows]]
            texts = [data[a : max(a, b - 1)].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            cols = {"doc_id": piece.column("doc_id"), "n_words": pa.array(np.diff(rows)), "n_removed": pa.array(tk.segment_sum(gone, rows, np.int64)), "kept_sha256": pa.array([sha256(t).hexdigest() for t in texts], pa.string())}
            if with_text:
                cols["kept"] = pa.array([t.decode("utf-8", "surrogatepass") for t in texts], pa.string())
            out.append(pa.table(cols))
        return pa.concat_tables(out)

    return run


class FingerprintIndex:
    """An index in the folder ``root`` of the shared store: opened if it is there, else begun with so many buckets.

    One writer at a time. A batch counts once its state row is written; an
    ``add`` that fails leaves unused files and can be repeated.
    """

    def __init__(self, spark, root: str, buckets: int | None = None, fanout: int = FANOUT, hot: int = HOT):
        self.spark, self.root, self.fanout, self.hot = spark, root.rstrip("/"), fanout, hot
        self.state = {"version": 0, "buckets": buckets or tk.parts(spark), "chunks": 0, "texts": [], "runs": []}
        try:
            last = spark.read.schema("version long, state string").parquet(self._path("state")).orderBy(F.desc("version")).first()
        except AnalysisException:  # no such folder yet
            last = None
        if last:
            self.state = json.loads(last["state"])
        self._texts = [Chunks.reopen(spark, **t) for t in self.state["texts"]]

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _runs(self, names: list[str]) -> DataFrame:
        out = self.spark.createDataFrame([], _RUN)
        for name in names:
            out = out.union(self.spark.read.schema(_RUN).parquet(self._path(name)))
        return out

    def _write(self, df: DataFrame, name: str, by: str | None = None) -> None:
        out = df.write.mode("overwrite").option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(self._path(name))
        tk.release(self.spark)

    def add(self, docs: DataFrame, with_text: bool = False) -> DataFrame:
        """Hold a batch and return, per row of docs (doc_id, text), what ``drop_repeated_windows`` does; documents of earlier batches count as smaller."""
        state, tag, old = dict(self.state), uuid.uuid4().hex[:12], list(self.state["runs"])
        if len(old) >= self.fanout:
            n = state["buckets"]
            while state["chunks"] > 2 * n:
                n *= 2
            self._write(self._runs(old).groupBy("bucket").applyInArrow(_compact(n), _RUN), f"run-{tag}-0")
            state |= {"buckets": n, "runs": [f"run-{tag}-0"]}
        chunks = Chunks(docs, self._path(f"texts-{tag}"), state["chunks"])
        offers = chunks.map(offer(KIND, state["buckets"]), OFFERS)
        met = offers.groupBy("bucket").cogroup(self._runs(state["runs"]).groupBy("bucket")).applyInArrow(_merge(self.hot), _MET)
        self._write(met, f"met-{tag}", by="old")
        del offers, met
        shared = self.spark.read.schema("chunk int, shared array<long>, hot array<long>, old boolean").parquet(self._path(f"met-{tag}")).filter("old").drop("old")
        sent = self.spark.createDataFrame([], SEGMENTS)
        for texts in [*self._texts, chunks]:
            sent = sent.union(texts.answer(shared, send(KIND, state["buckets"]), SEGMENTS))
        self._write(with_hot(sent.groupBy("bucket").applyInArrow(_verify(chunks.first), COVERS), shared), f"covers-{tag}")
        del sent
        answers = self.spark.read.schema(COVERS).parquet(self._path(f"covers-{tag}"))
        result = f"{self.root}-result-{tag}"
        out = chunks.answer(answers, _remove(with_text), _REMOVED + (", kept string" if with_text else ""))
        out.write.option("compression", "zstd").parquet(result)
        for used in (f"covers-{tag}", f"met-{tag}/old=true"):
            tk.remove(self.spark, self._path(used))
        self._texts.append(chunks)
        texts = [{"path": t.path, "first": t.first, "n": t.n, "files": t.files} for t in self._texts]
        state |= {"version": state["version"] + 1, "chunks": chunks.first + chunks.n, "texts": texts, "runs": [*state["runs"], f"met-{tag}/old=false"]}
        self.spark.createDataFrame([(state["version"], json.dumps(state))], "version long, state string").coalesce(1).write.mode("append").parquet(self._path("state"))
        self.state = state
        for run in set(old) - set(state["runs"]):
            tk.remove(self.spark, self._path(run))
        return self.spark.read.schema(out.schema).parquet(result)

    def close(self) -> None:
        """Forget the catalogue's entries; the folder stays."""
        for t in self._texts:
            t.forget()


def drop_repeated_windows(docs: DataFrame, batches: int = BATCHES, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """Per row of docs (doc_id, text): n_words, n_removed, kept_sha256, and the kept words as ``kept`` if with_text.

    Words of windows that also start in a document of smaller doc_id go. Null
    texts have no words; rows of one id are no smaller than one another; null
    ids count as larger than all. An empty table gives no rows; other columns
    of docs are left out. The index is begun for this call, fed in ``batches``
    of ascending doc_id, and dropped at the end.
    """
    with tk.Workspace(docs.sparkSession, "substring-dedup") as work:
        size, cuts = docs.agg(F.sum(F.octet_length("text")), F.percentile_approx("doc_id", [k / batches for k in range(1, batches)] or [0.5], 10000)).first()
        cuts = sorted(set(cuts or [])) if batches > 1 else []
        index = FingerprintIndex(docs.sparkSession, work.path("index"), max(tk.parts(docs.sparkSession), -(-(size or 0) // CHUNK_BYTES)), hot=hot)
        batch = sum((F.coalesce(F.col("doc_id") > c, F.lit(True)).cast("int") for c in cuts), F.lit(0))
        try:
            out = index.add(docs.filter(batch == 0), with_text)
            for k in range(1, len(cuts) + 1):
                out = out.union(index.add(docs.filter(batch == k), with_text))
            return work.keep(out)
        finally:
            index.close()


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """``drop_repeated_windows`` of all documents."""
    return drop_repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
