"""What the two substring operators share: chunks of documents, anchors that several documents hold, and segments that meet by anchor.

A window is dealt to its anchor, the least gram in it, so equal windows have
equal anchors at equal places. An anchor that only one document holds rules all
its windows out, which leaves the few that may repeat. Documents lie in chunks
of bounded size in a bucketed table; a pass over chunks sends per-bucket
arrays, already reduced within the chunk, and gets its answers back by chunk,
without moving the texts again.

A segment is a run of windows with one anchor; it travels with its bytes, and
equality is always decided by the bytes, hashes only bring candidates together.
An anchor of very many occurrences has its windows dealt by the hash of the
whole window, so that no bucket holds all that share a frequent gram; what
happens to them there is the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import textkit as tk

#: Bytes of text in a chunk, about.
CHUNK_BYTES = 4 << 20
#: Occurrences from which on an anchor's windows are dealt by their own hashes.
HOT = 4096
#: Bases of the content hashes: a chunk that finds two contents under one hash takes the next.
BASES = (tk._MUL, 0xD1342543DE82EF95, 0xA0761D6478BD642F)
#: Segments are the most of what is shuffled.
PACK = "zstd"


@dataclass
class Cut:
    """Units of some texts: hash of the gram at each, row bounds among them, and the bytes, with each unit's place there (None: units are bytes)."""

    grams: np.ndarray
    rows: np.ndarray
    data: np.ndarray
    left: np.ndarray | None = None
    right: np.ndarray | None = None

    def span(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size in bytes of the units first..last."""
        if self.left is None:
            return first, last - first + 1
        return self.left[first], self.right[last] - self.left[first]


@dataclass(frozen=True)
class Kind:
    """How texts are cut, the units of a window and of a gram, and whether a window of a frequent anchor brings along the rest of its run."""

    cut: Callable[[np.ndarray, np.ndarray], Cut]
    window: int
    gram: int
    tail: bool

    def runs(self, cut: Cut) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last window start of each run of windows with one anchor, and the anchor's hash."""
        first, last, at = tk.anchored(cut.grams, cut.rows, self.window, self.gram)
        return first, last, cut.grams[at]

    def segments(self, cut: Cut, hot: np.ndarray, shared: np.ndarray | None = None):
        """First and last unit and key of each segment (of the shared anchors), and whether it stands for its first window alone."""
        first, last, h = self.runs(cut)
        if shared is not None:
            ok = lookup(shared, h)
            first, last, h = first[ok], last[ok], h[ok]
        many = lookup(hot, h)
        end = last + self.window - 1
        if not many.any():
            return first, end, h, many
        own, of = spread(first[many], last[many])
        begin, size = cut.span(own, own + self.window - 1)
        key = tk.ranges(tk.prefix(cut.data.astype(np.uint64) + np.uint64(1)), begin, begin + size)
        stop = end[many][of] if self.tail else own + self.window - 1
        return np.concatenate([first[~many], own]), np.concatenate([end[~many], stop]), np.concatenate([h[~many], key]), np.repeat([False, True], [int((~many).sum()), len(own)])


class Chunks:
    """``documents`` as a table bucketed by chunk; each pass reads it in place. Chunks are numbered from ``first``."""

    def __init__(self, docs: DataFrame, path: str, first: int = 0):
        self.spark = spark = docs.sparkSession
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.first, self.n, self.files, self.path = first, max(tk.parts(spark), -(-size // CHUNK_BYTES)), tk.parts(spark), path
        self.name = f"tidemill_chunks_{uuid.uuid4().hex[:12]}"
        rows = docs.select((F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(self.n)) + first).cast("int").alias("chunk"), "doc_id", "text")
        dealt = rows.repartition(self.files, "chunk")
        dealt.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(self.files, "chunk").sortBy("chunk").saveAsTable(self.name)
        del rows, dealt
        tk.release(spark)

    @classmethod
    def reopen(cls, spark, path: str, first: int, n: int, files: int) -> Chunks:
        """The table that an earlier session may have written."""
        self = cls.__new__(cls)
        self.spark, self.path, self.first, self.n, self.files = spark, path, first, n, files
        self.name = f"tidemill_chunks_{uuid.uuid4().hex[:12]}"
        spark.sql(f"CREATE TABLE {self.name} (chunk INT, doc_id BIGINT, text STRING) USING parquet OPTIONS (path '{path}') CLUSTERED BY (chunk) SORTED BY (chunk) INTO {files} BUCKETS")
        return self

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def map(self, run, schema: str) -> DataFrame:
        """run(chunk's table) of each chunk."""
        return self.table().groupBy("chunk").applyInArrow(run, schema)

    def answer(self, answers: DataFrame, run, schema: str) -> DataFrame:
        """run(chunk's table, chunk's answers) of each chunk."""
        own = answers.filter(F.col("chunk").between(self.first, self.first + self.n - 1))
        return self.table().groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(run, schema)

    def forget(self) -> None:
        """Take the table out of the catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def pieces(table: pa.Table):
    """(piece, doc_ids, bytes, offsets) of slices of a chunk; rows of null doc_id come with their id masked as the largest."""
    for batch in table.to_batches():
        for piece in tk.slices([batch]):
            ids = piece.column("doc_id").fill_null((1 << 63) - 1).to_numpy()
            yield piece, ids, *tk.utf8(piece.column("text"))


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts keys, and the start of each run of equal keys in it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    return order, np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)


def same(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes buf[a : a + size] and buf[b : b + size] agree, pair by pair."""
    out = np.ones(len(a), bool)
    total = np.cumsum(size)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 19), "right")))
        x, of = spread(a[at:to], a[at:to] + size[at:to] - 1)
        differ = buf[x] != buf[x + (b[at:to] - a[at:to])[of]]
        out[at:to][of[differ]] = False
        at = to
    return out


def identical(buf: np.ndarray, begin: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each string buf[begin : begin + size] among the distinct ones, and one place of each; hashes only propose."""
    order, start = grouped(hashes)
    number = np.empty(len(order), np.int64)
    number[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
    one = order[start]
    rest = np.flatnonzero(one[number] != np.arange(len(order)))
    like = one[number[rest]]
    ok = size[rest] == size[like]
    ok[ok] = same(buf, begin[rest][ok], begin[like][ok], size[rest][ok])
    if not ok.all():  # strings that share a hash and no more
        more: dict[bytes, int] = {}
        for k in rest[~ok].tolist():
            number[k] = more.setdefault(buf[begin[k] : begin[k] + size[k]].tobytes(), len(one) + len(more))
        first = np.zeros(len(more), np.int64)
        first[number[rest[~ok]][::-1] - len(one)] = rest[~ok][::-1]
        one = np.concatenate([one, first])
    return number, one


def extremes(number: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least lo and greatest hi of each number; all from 0 on occur."""
    order, start = grouped(number)
    if not len(start):
        return lo, hi
    return np.minimum.reduceat(lo[order], start), np.maximum.reduceat(hi[order], start)


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    if values.dtype == np.uint64:
        values = values.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def flat(table: pa.Table, column: str) -> np.ndarray:
    """All values of a list column, in order of rows."""
    parts = [c.flatten() for c in table.column(column).chunks]
    return np.concatenate([p.to_numpy(zero_copy_only=False) for p in parts]) if parts else np.zeros(0, np.int64)


def owners(table: pa.Table, lists_column: str, owner: str) -> np.ndarray:
    """For each value of ``flat``, its row's ``owner``."""
    sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in table.column(lists_column).chunks] or [np.zeros(0, int)])
    return np.repeat(table.column(owner).to_numpy(), sizes)


_TYPES = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def nothing(ddl: str) -> pa.Table:
    """An empty table of a schema."""
    return pa.table({c.split()[0]: pa.array([], _TYPES[c.split()[1]]) for c in ddl.split(", ")})


def buckets(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(24)) % np.uint64(n)).astype(np.int64)


OFFERS = "bucket int, chunk int, h array<long>, n array<int>"


def offer(kind: Kind, n: int):
    """Anchors of a chunk by bucket, each once, with its occurrences (negative: all in one document)."""

    def run(table: pa.Table) -> pa.Table:
        found, docs = [], []
        for _, ids, buf, offsets in pieces(table):
            cut = kind.cut(buf, offsets)
            first, _, h = kind.runs(cut)
            found.append(h)
            docs.append(ids[np.searchsorted(cut.rows, first, "right") - 1])
        h, doc = np.concatenate(found), np.concatenate(docs)
        order, start = grouped(h)
        count = np.diff(np.append(start, len(h)))
        several = np.minimum.reduceat(doc[order], start) != np.maximum.reduceat(doc[order], start) if len(h) else np.zeros(0, bool)
        h, count = h[order][start], np.where(several, count, -count)
        order, start = grouped(buckets(h, n))
        bounds = np.append(start, len(h))
        b = buckets(h, n)[order][start]
        chunk = np.full(len(b), table.column("chunk")[0].as_py())
        return pa.table({"bucket": pa.array(b, pa.int32()), "chunk": pa.array(chunk, pa.int32()), "h": lists(h[order], bounds, pa.int64()), "n": lists(count[order], bounds, pa.int32())})

    return run


SHARED = "chunk int, shared array<long>, hot array<long>"


def told(chunk: np.ndarray, h: np.ndarray, hot: np.ndarray) -> pa.Table:
    """Rows of SHARED: anchors for each chunk, those that are hot also by themselves."""
    by, first = grouped(chunk)
    bounds = np.append(first, len(by))
    hots = np.concatenate([[0], np.cumsum(hot[by])])
    return pa.table({"chunk": pa.array(chunk[by][first], pa.int32()), "shared": lists(h[by], bounds, pa.int64()), "hot": lists(h[by][hot[by]], hots[bounds], pa.int64())})


def _share(hot: int):
    """Of a bucket's anchors, those that several documents hold, back to the chunks."""

    def run(table: pa.Table) -> pa.Table:
        h, n, chunk = flat(table, "h"), flat(table, "n").astype(np.int64), owners(table, "h", "chunk")
        order, start = grouped(h)
        size = np.diff(np.append(start, len(h)))
        shared = (size > 1) | (np.maximum.reduceat(n[order], start) > 0)
        many = shared & (np.add.reduceat(np.abs(n[order]), start) > hot)
        ok = order[np.repeat(shared, size)]
        return told(chunk[ok], h[ok], np.repeat(many, size)[np.repeat(shared, size)])

    return run


def shared_anchors(chunks: Chunks, kind: Kind, work: tk.Workspace, hot: int = HOT) -> DataFrame:
    """SHARED: the anchors of each chunk that another document, there or elsewhere, holds too."""
    offers = chunks.map(offer(kind, chunks.n), OFFERS)
    shared = work.save(offers.groupBy("bucket").applyInArrow(_share(hot), SHARED), "shared")
    del offers
    tk.release(chunks.spark)
    return shared


SEGMENTS = "bucket int, chunk int, base int, ch array<long>, anchor array<long>, size array<int>, lo array<long>, hi array<long>, bytes binary"


def _contents(kind: Kind, table: pa.Table, shared: np.ndarray, hot: np.ndarray, base: int):
    """The distinct segments of a chunk (hash, key, size, least and greatest document, bytes), or None if two contents share a hash."""
    parts = []
    for _, ids, buf, offsets in pieces(table):
        cut = kind.cut(buf, offsets)
        first, last, key, lone = kind.segments(cut, hot, shared)
        if len(first):
            begin, size = cut.span(first, last)
            content = tk.ranges(tk.prefix(cut.data.astype(np.uint64) + np.uint64(1), base), begin, begin + size, base)
            number, one = identical(cut.data, begin, size, content)
            doc = ids[np.searchsorted(cut.rows, first, "right") - 1]
            at, _ = spread(begin[one], begin[one] + size[one] - 1)
            parts.append((content[one], key[one], np.where(lone, -size, size)[one], *extremes(number, doc, doc), cut.data[at]))
    if not parts:
        return ()
    content, key, size, lo, hi, data = map(np.concatenate, zip(*parts, strict=True))
    begin = np.cumsum(np.abs(size)) - np.abs(size)
    number, one = identical(data, begin, np.abs(size), content)
    if len(np.unique(content[one])) < len(one):
        return None
    return content[one], key[one], size[one], *extremes(number, lo, hi), data, begin[one]


def send(kind: Kind, n: int):
    """A chunk's segments of shared anchors, each content once, to the buckets of their keys."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        shared, hot = (np.sort(flat(answers, c).view(np.uint64)) for c in ("shared", "hot"))
        for k, base in enumerate(BASES if len(shared) else ()):
            found = _contents(kind, table, shared, hot, base)
            if found is not None:
                break
        else:
            found = ()
        if not found:
            return nothing(SEGMENTS)
        content, key, size, lo, hi, data, begin = found
        width = np.abs(size)
        order, start = grouped(buckets(key, n))
        bounds = np.append(start, len(order))
        at, _ = spread(begin[order], begin[order] + width[order] - 1)
        ends = np.concatenate([[0], np.cumsum(width[order])])[bounds]
        data = data[at]
        blobs = [pa.compress(data[a:b].tobytes(), codec=PACK, asbytes=True) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        b = buckets(key, n)[order][start]
        chunk = table.column("chunk")[0].as_py()
        return pa.table({
            "bucket": pa.array(b, pa.int32()), "chunk": pa.array(np.full(len(b), chunk), pa.int32()), "base": pa.array(np.full(len(b), k), pa.int32()),
            "ch": lists(content[order], bounds, pa.int64()), "anchor": lists(key[order], bounds, pa.int64()), "size": lists(size[order], bounds, pa.int32()),
            "lo": lists(lo[order], bounds, pa.int64()), "hi": lists(hi[order], bounds, pa.int64()), "bytes": pa.array(blobs, pa.binary()),
        })

    return run


class Segments:
    """What a bucket got: entries (chunk, hash, key, documents), and ``one`` entry of each distinct content, by number."""

    def __init__(self, table: pa.Table):
        self.content, self.key = flat(table, "ch").view(np.uint64), flat(table, "anchor").view(np.uint64)
        size = flat(table, "size").astype(np.int64)
        self.size, self.lone = np.abs(size), size < 0
        self.lo, self.hi = flat(table, "lo"), flat(table, "hi")
        self.chunk, self.base = owners(table, "ch", "chunk"), owners(table, "ch", "base")
        whole = [sum(map(abs, x)) for x in table.column("size").to_pylist()]
        self.buf = np.frombuffer(b"".join([pa.decompress(x, n, codec=PACK, asbytes=True) for x, n in zip(table.column("bytes").to_pylist(), whole, strict=True)]), np.uint8)
        self.begin = np.cumsum(self.size) - self.size
        own = tk.ranges(tk.prefix(self.buf.astype(np.uint64) + np.uint64(1)), self.begin, self.begin + self.size) if (self.base > 0).any() else self.content
        self.number, self.one = identical(self.buf, self.begin, self.size, own)
        self.least, self.most = extremes(self.number, self.lo, self.hi)


COVERS = "chunk int, base int, ch array<long>, anchor array<long>, start array<int>, stop array<int>, lo array<long>, hot array<long>"


def covers(got: Segments, what: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, first: int = 0) -> pa.Table:
    """Stretches left..right (units) of contents ``what`` that yield to a smaller document ``doc``, back to the chunks from ``first`` on that hold a greater one."""
    order, _ = grouped(what)  # the stretches of a content stand together
    what, left, right, doc = what[order], left[order], right[order], doc[order]
    at, entry = spread(np.searchsorted(what, got.number, "left"), np.searchsorted(what, got.number, "right") - 1)
    ok = (got.hi[entry] > doc[at]) & (got.chunk[entry] >= first)
    at, entry = at[ok], entry[ok]
    by, head = grouped(got.chunk[entry])
    at, entry = at[by], entry[by]
    bounds = np.append(head, len(at))
    none = pa.ListArray.from_arrays(pa.array(np.zeros(len(head) + 1), pa.int32()), pa.array([], pa.int64()))
    return pa.table({
        "chunk": pa.array(got.chunk[entry][head], pa.int32()), "base": pa.array(got.base[entry][head], pa.int32()), "ch": lists(got.content[entry], bounds, pa.int64()), "anchor": lists(got.key[entry], bounds, pa.int64()),
        "start": lists(left[at], bounds, pa.int32()), "stop": lists(right[at], bounds, pa.int32()), "lo": lists(doc[at], bounds, pa.int64()), "hot": none,
    })


def with_hot(found: DataFrame, shared: DataFrame) -> DataFrame:
    """COVERS and, for each chunk, its hot anchors."""
    empty = {"base": "int", "ch": "array<long>", "anchor": "array<long>", "start": "array<int>", "stop": "array<int>", "lo": "array<long>"}
    hot = shared.filter("size(hot) > 0").select("chunk", *(F.lit(0).alias(c) if t == "int" else F.array().cast(t).alias(c) for c, t in empty.items()), "hot")
    return found.union(hot)


class Marks:
    """A chunk's answers, to mark its units."""

    def __init__(self, answers: pa.Table):
        content = flat(answers, "ch").view(np.uint64)
        order = np.argsort(content, kind="stable")
        self.content, self.key = content[order], flat(answers, "anchor").view(np.uint64)[order]
        self.start, self.stop, self.lo = (flat(answers, c)[order].astype(np.int64) for c in ("start", "stop", "lo"))
        self.hot = np.sort(flat(answers, "hot").view(np.uint64))
        self.base = BASES[max(answers.column("base").to_pylist(), default=0)]

    def gone(self, kind: Kind, cut: Cut, ids: np.ndarray) -> np.ndarray:
        """Which units of the cut go."""
        n = int(cut.rows[-1])
        if not len(self.content) or not n:
            return np.zeros(n, bool)
        first, last, key, _ = kind.segments(cut, self.hot)
        begin, size = cut.span(first, last)
        content = tk.ranges(tk.prefix(cut.data.astype(np.uint64) + np.uint64(1), self.base), begin, begin + size, self.base)
        at, of = spread(np.searchsorted(self.content, content, "left"), np.searchsorted(self.content, content, "right") - 1)
        doc = ids[np.searchsorted(cut.rows, first, "right") - 1]
        ok = (doc[of] > self.lo[at]) & (key[of] == self.key[at])
        at, of = at[ok], of[ok]
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, first[of] + self.start[at], 1)
        np.add.at(edge, first[of] + self.stop[at], -1)
        return np.cumsum(edge[:-1]) > 0


def lookup(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key is among the sorted ``known``."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges first..last, and the number of each one's range."""
    size = last - first + 1
    of = np.repeat(np.arange(len(first)), size)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size), of
