"""Documents linked by the Jaccard similarity of their word shingles: what operators 10 and 12 share.

An operator proposes: it gives every class of equal sets some keys, and a test
that rules pairs out. Here the classes that share a key meet, every link is
confirmed on the full shingle sets, and links become components.

A bucket (the classes of one key) of m members is first met as a star:
everyone against its least member, m - 1 pairs. Components of the confirmed
links follow, and only buckets in which several components remain are looked
at again, across components, in blocks of bounded size. So a large group of
copies costs as many rows as members, and yet no link between components goes
unseen.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import textkit as tk
from tidemill.llm.components import components
from tidemill.llm.skew import frequent, lookup

#: Members of a block in a bucket, and pairs of a centre in one verification group, at most about.
BLOCK, GROUP = 256, 48
#: Keys of a class, the least ones, that travel with it so that a pair is proposed once.
CARRIED = 32

_STEP = np.uint64(0x9E3779B97F4A7C15)


class Shingles:
    """Distinct shingles of ``width`` words of each row of a buffer, A-Z lower-cased; fewer words make one of all, none make none."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self, buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Per row two rows of 64 bits a shingle, repeats included."""
        buf = tk.LOWER[buf]
        start, end, rows = tk.words(buf, offsets, tk.NOT_BLANK)
        codes = tk.word_codes(buf, start, end)
        grams = self._chain(codes, self.width)
        out = []
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            out.append(grams[:, a : b - self.width + 1] if b - a >= self.width else self._chain(codes[:, a:b], b - a))
        return out

    @staticmethod
    def _chain(codes: np.ndarray, width: int) -> np.ndarray:
        n = codes.shape[1] - width + 1 if width else 0
        h = np.full((2, max(0, n)), width, np.uint64)
        for k in range(width):
            h = tk.mix(h * _STEP + codes[:, k : k + n])
        return h

    def sets(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Per row the distinct first halves, ascending, and a 128-bit key of the whole set as two longs."""
        first, keys = [], []
        for g in self(buf, offsets):
            a, b = np.unique(g[0]), np.unique(g[1])
            first.append(a)
            keys.append(blake2b(a.tobytes() + b.tobytes(), digest_size=16).digest())
        return first, np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)


def _distinct(g: np.ndarray) -> np.ndarray:
    """Shingles of one set, ascending, without repeats."""
    g = g[:, np.lexsort((g[1], g[0]))]
    new = np.ones(g.shape[1], bool)
    new[1:] = (g[:, 1:] != g[:, :-1]).any(0)
    return g[:, new]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Shingles in both of two ``_distinct`` sets, by all 128 bits."""
    if not a.shape[1] or not b.shape[1]:
        return 0
    both = np.concatenate([a, b], axis=1)
    return both.shape[1] - _distinct(both).shape[1] if _clash(a) or _clash(b) else int(_met(a, b).sum())


def _clash(a: np.ndarray) -> bool:
    return bool((a[0, 1:] == a[0, :-1]).any())


def _met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(a[0], b[0]), a.shape[1] - 1)
    return (a[0, at] == b[0]) & (a[1, at] == b[1])


def column(values) -> pa.Array:
    return values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values


def _signatures(values) -> np.ndarray:
    """As rows of words if all are of one length, else as an array of bytes."""
    found = column(values).to_pylist()
    if len(set(map(len, found))) > 1:
        out = np.empty(len(found), object)
        out[:] = found
        return out
    return np.frombuffer(b"".join(found), np.uint64).reshape(len(found), -1)


def _confirm(width: int, percent: int) -> Callable:
    def run(batches):
        """Rows (a, salt, b, text) in order, the centre's own text(s) first: pairs whose full sets link."""
        group, centre, shingles = None, [], Shingles(width)
        for piece in tk.slices(batches):
            left, right = [], []
            grams = shingles(*tk.utf8(piece.column("text")))
            for a, salt, b, g in zip(*(piece.column(c).to_pylist() for c in ("a", "salt", "b")), grams, strict=True):
                if (a, salt) != group:
                    group, centre = (a, salt), []
                s = _distinct(g)
                if a == b:
                    centre.append(s)
                    continue
                for c in centre:
                    met = common(c, s)
                    if met and 100 * met >= percent * (c.shape[1] + s.shape[1] - met):
                        left.append(a)
                        right.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _carried(values) -> np.ndarray:
    """Rows of keys as a matrix; short ones are filled up with their greatest, which is not less than any."""
    values = column(values)
    size = values.value_lengths().to_numpy().astype(np.int64)
    flat, begin = values.flatten().to_numpy(), np.cumsum(size) - size
    return flat[begin[:, None] + np.minimum(np.arange(CARRIED)[None, :], size[:, None] - 1)]


def _first_shared(x: np.ndarray, y: np.ndarray, here: int) -> np.ndarray:
    """Whether no carried key that both rows have is less than ``here``."""
    out = np.ones(len(x), bool)
    for at in range(0, len(x), 4096):
        p, q = x[at : at + 4096], y[at : at + 4096]
        shared = ((p[:, :, None] == q[:, None, :]) & (p < here)[:, :, None]).any((1, 2))
        out[at : at + 4096] = ~shared
    return out


def _across(may: Callable) -> Callable:
    def cell(t: pa.Table):
        i, j, here = (t.column(c)[0].as_py() for c in ("i", "j", "bucket"))
        block, node, comp, n = (t.column(c).to_numpy() for c in ("block", "node", "component", "n"))
        sig, keys = _signatures(t.column("sig")), _carried(t.column("carried"))
        own, other = np.flatnonzero(block == i), np.flatnonzero(block == j)
        for at in range(0, len(own), 64):
            u = own[at : at + 64]
            x, y = np.nonzero(comp[u][:, None] != comp[other][None, :])
            if i == j:
                x, y = x[u[x] < other[y]], y[u[x] < other[y]]
            x, y = u[x], other[y]
            near = may(n[x], sig[x], n[y], sig[y])
            x, y = x[near], y[near]
            once = _first_shared(keys[x], keys[y], here)
            p, q = node[x[once]], node[y[once]]
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

    def run(batches):
        """Rows (bucket, i, j, block, node, component, n, sig, carried) in order of cell: pairs of different components that may link."""
        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            key = np.stack([batch.column(c).to_numpy() for c in ("bucket", "i", "j")], 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            if held and tuple(held[-1].slice(held[-1].num_rows - 1).select(["bucket", "i", "j"]).to_pylist()[0].values()) != tuple(key[0].tolist()):
                yield from cell(pa.concat_tables(held))
                held = []
            for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True):
                held.append(table.slice(a, b - a))
                if b < len(key):
                    yield from cell(pa.concat_tables(held))
                    held = []
        if held:
            yield from cell(pa.concat_tables(held))

    return run


class Linker:
    """Links among classes (node, n, sig, keys): a node is the least doc_id of a class, keys are what it may share with those it links to.

    ``may(n_a, sig_a, n_b, sig_b)`` says which rows of pairs may link; those ruled out must not.
    """

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, percent: int, may: Callable, work: tk.Workspace):
        self.docs, self.classes, self.width, self.percent, self.may, self.work = docs, classes, width, percent, may, work

    def _links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full shingle sets link. Pairs of one centre are salted into bounded groups."""
        spread = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / GROUP).cast("int"))
        members = lookup(pairs, spread, ["a"], ["salts"], frequent(spread.select("a", "n"), "n"), F.col("b")).select("a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), "b")
        centres = spread.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("b"))
        texts = self.docs.select(F.col("doc_id").alias("b"), "text")
        rows = texts.join(members.union(centres).hint("shuffle_hash"), "b").select("a", "salt", "b", "text", (F.col("a") != F.col("b")).alias("member"))
        dealt = rows.repartition(tk.tasks(self.docs), "a", "salt").sortWithinPartitions("a", "salt", "member")
        return dealt.mapInArrow(_confirm(self.width, self.percent), "a long, b long")

    def _likely(self, pairs: DataFrame) -> DataFrame:
        ends = self.classes.select("node", "n", "sig")
        side = lambda s: ends.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}"))
        may = self.may

        def run(batches):
            for b in batches:
                ok = may(b.column("n_a").to_numpy(), _signatures(b.column("sig_a")), b.column("n_b").to_numpy(), _signatures(b.column("sig_b")))
                yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], names=["a", "b"])

        return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")

    def _shared(self) -> DataFrame:
        """(bucket, centre, size, node) of members of buckets with company."""
        met = self.classes.select("node", F.explode("keys").alias("bucket"))
        centres = met.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("size")).filter("size > 1")
        centres = self.work.save(centres, "centres")
        top = frequent(centres.select("bucket", "size"), "size")
        shared = lookup(met, centres, ["bucket"], ["centre", "size"], top, F.col("node")).filter("centre IS NOT NULL")
        shared = self.work.save(shared, "shared")
        tk.release(self.docs.sparkSession)
        return shared

    def _rest(self, placed: DataFrame) -> DataFrame:
        """Pairs across components of rows (bucket, node, component, size). Of buckets with the same members the least is enough."""
        mixed = placed.groupBy("bucket").agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"), F.first("size").alias("size"),
            *(F.sum(F.xxhash64(F.lit(k), "node").cast("decimal(38,0)")).alias(f"same{k}") for k in (1, 2)),
        ).filter("lo <> hi")
        mixed = mixed.groupBy("size", "same1", "same2").agg(F.min("bucket").alias("bucket")).select("bucket")
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        ends = self.classes.select("node", "n", "sig", F.slice(F.array_sort("keys"), 1, CARRIED).alias("carried"))
        cells = placed.join(mixed, "bucket").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        cells = cells.join(ends, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = cells.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "n", "sig", "carried")
        dealt = cells.repartition(tk.tasks(self.docs), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
        return dealt.mapInArrow(_across(self.may), "a long, b long").distinct()

    def components(self) -> DataFrame:
        """(node, component) of the nodes that link."""
        work, shared = self.work, self._shared()
        stars = shared.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
        first = work.save(self._links(work.save(self._likely(stars), "likely")), "first")
        tk.release(self.docs.sparkSession)  # shuffle files of keys and texts
        labels = components(first, work, "near")
        placed = shared.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        placed = work.save(placed.select("bucket", "node", "component", "size"), "placed")
        second = work.save(self._links(work.save(self._rest(placed), "rest")), "second")
        return components(first.union(second), work, "all")

    def pairs(self) -> DataFrame:
        """Every link (a, b), a < b, between classes: as many rows as there are links."""
        placed = self._shared().select("bucket", "node", F.col("node").alias("component"), "size")
        return self._links(self.work.save(self._rest(placed), "rest"))


def classes(signed: DataFrame) -> DataFrame:
    """One row a set of rows (doc_id, n, k1, k2, sig, keys); null ids and empty sets are in none."""
    filled = signed.filter("n > 0 AND doc_id IS NOT NULL")
    return filled.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys"), F.count("*").alias("copies"))


def labelled(signed: DataFrame, found: DataFrame, linked: DataFrame, work: tk.Workspace) -> DataFrame:
    """doc_id, n_shingles, component_id of every row signed, by its class in ``found`` and that one's component; null ids and empty sets are their own."""
    known = found.select("k1", "k2", "node", "copies").join(linked, "node", "left").select("k1", "k2", "copies", F.coalesce("component", "node").alias("component_id"))
    known = work.save(known, "known")
    out = lookup(signed.select("doc_id", "n", "k1", "k2"), known, ["k1", "k2"], ["component_id"], frequent(known.select("k1", "k2", "copies"), "copies"), F.col("doc_id"))
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
