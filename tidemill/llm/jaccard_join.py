"""N-gram Jaccard join by size, light and heavy sets apart (operator 12).

Shingles have one order for all: those on a list of very frequent ones come
last, the others go by their hash. A set of n shingles lacks at most
slack(n) = n - ceil(0.85 n) of its own in anything it links to, so two linked
sets share at least c of their first slack + c shingles:

- a light set gives every subset of c = 2 of its first slack + 2 shingles as a
  key, so light sets meet only if they share two;
- a heavy one scans the inverted lists of its first slack + 1 shingles, on which
  every heavy set stands, and every light one large enough to link to one.

The boundary is the slack at which subsets begin to cost more than the lists
they spare (see ``boundary``); whatever it is, no link is lost. A parity bitmap of
a set bounds its symmetric difference from below and so rules pairs out for
certain; links are confirmed and joined in ``linking``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import textkit as tk
from tidemill.llm.linking import Linker, Shingles, classes, labelled

#: Words of a shingle; a link is 100 * intersection >= PERCENT * union.
SHINGLE, PERCENT = 4, 85
#: Frequent shingles that come last in the order (a broadcast of that many longs); a task offers those that OFTEN of its sets hold.
COMMON, OFTEN = 1 << 16, 8
#: Shingles a task counts at a time.
COUNTED = 1 << 22
#: Slack of a light set, at most: 465 subsets.
LIGHT = 29
#: Bits of a parity bitmap: two or more a shingle, within these bounds. Pairs compared at a time: of so many bytes.
LEAST_BITS, MOST_BITS, COMPARED = 2048, 1 << 16, 1 << 23

_PAIR, _LIST = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


def slack(n):
    """Shingles of a set of n that what it links to may lack."""
    return n - -(-PERCENT * n // 100)


_COUNTS = "gram long, n long, square long"


def _counts(batches):
    """Of what a task counts at a time: (gram, n) of the frequent shingles, and (null, n, square): occurrences of the others, and the lengths of their lists squared, summed."""
    shingles, held, size = Shingles(SHINGLE), [], 0

    def flush():
        grams, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= OFTEN
        few = n[~often].astype(np.int64)
        gram = pa.array(np.append(grams[often].view(np.int64), 0), mask=np.append(np.zeros(often.sum(), bool), True))
        square = np.append(np.zeros(often.sum(), np.int64), (few * few).sum())
        return pa.RecordBatch.from_arrays([gram, pa.array(np.append(n[often], few.sum())), pa.array(square)], names=["gram", "n", "square"])

    for piece in tk.slices(batches):
        own = [np.unique(g[0]) for g in shingles(*tk.utf8(piece.column("text")))]
        held += own
        size += sum(map(len, own))
        if size > COUNTED:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def boundary(occurrences: int, squares: int, blocks: int) -> int:
    """The greatest slack of a light set.

    A set of slack d costs (d+2)(d+1)/2 keys as a light one, and as a heavy one
    d + 1 keys and what else stands on their lists. Were the lists as uneven in
    all as they are in the blocks counted, a shingle's list would hold L more
    sets, L = blocks * (squares / occurrences - 1); d <= 2 L makes subsets the cheaper.
    """
    return max(0, min(LIGHT, int(2 * blocks * (squares / occurrences - 1)))) if occurrences else 0


def keys(grams: np.ndarray, common: np.ndarray, light: int) -> np.ndarray:
    """Keys of one set (ascending shingles): subsets if its slack is at most ``light``, lists if it may meet a set of more slack."""
    n = len(grams)
    d = slack(n)
    first = grams
    if len(common):
        late = common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] == grams
        first = np.concatenate([grams[~late], grams[late]])
    out = []
    if d <= light:
        i, j = np.triu_indices(min(n, d + 2), 1)
        a, b = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
        out.append(tk.mix(tk.mix(a ^ _PAIR) + b * _PAIR))
    if slack(100 * n // PERCENT) > light:  # the largest set it may link to
        out.append(tk.mix(first[: d + 1] ^ _LIST))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bitmap(grams: np.ndarray) -> bytes:
    """Which classes hold an odd number of the shingles."""
    power = min(MOST_BITS, max(LEAST_BITS, 2 * len(grams))).bit_length() - 1
    odd = np.bincount((grams >> np.uint64(64 - power)).astype(np.int64), minlength=1 << power) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _folded(maps: np.ndarray, size: int) -> np.ndarray:
    """Rows of bytes as those of ``size`` bytes: the parities of two neighbouring classes are that of the class of both."""
    while maps.shape[1] > size:
        maps = np.packbits(np.bitwise_xor.reduce(np.unpackbits(maps, axis=1).reshape(len(maps), -1, 2), axis=2), axis=1)
    return maps


def _unequal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unequal bits of pairs of bitmaps (rows of words, or bytes of several lengths)."""
    if a.ndim == b.ndim == 2 and a.shape[1] == b.shape[1]:
        step = max(1, COMPARED // (8 * a.shape[1]))
        return np.concatenate([np.bitwise_count(a[k : k + step] ^ b[k : k + step]).sum(1, dtype=np.int64) for k in range(0, len(a), step)] or [np.zeros(0, np.int64)])
    a, b = (x if x.ndim == 1 else np.array([r.tobytes() for r in x], object) for x in (a, b))
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    out = np.zeros(len(a), np.int64)
    for p, q in np.unique(sizes, axis=0).tolist():
        rows = np.flatnonzero((sizes == (p, q)).all(1))
        step = max(1, COMPARED // (8 * max(p, q)))
        for k in range(0, len(rows), step):
            x, y = (_folded(np.frombuffer(b"".join(m[rows[k : k + step]]), np.uint8).reshape(-1, n), min(p, q)) for m, n in ((a, p), (b, q)))
            out[rows[k : k + step]] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return out


def may(n_a, sig_a, n_b, sig_b) -> np.ndarray:
    """Of pairs with sizes and bitmaps, those that may link: unequal bits are never more than the shingles that only one set has."""
    ok = 100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b)
    both = (n_a + n_b)[ok]
    least = -(-PERCENT * both // (100 + PERCENT))
    ok[ok] = _unequal(sig_a[ok], sig_b[ok]) <= both - 2 * least
    return ok


_SIGNED = "doc_id long, n long, k1 long, k2 long, sig binary, keys array<long>"


def _signed(docs: DataFrame, light: int, common: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(common.tobytes())  # COMMON longs at most

    def run(batches):
        late, shingles = np.frombuffer(shared.value, np.uint64), Shingles(SHINGLE)
        for piece in tk.slices(batches):
            sets, ids = shingles.sets(*tk.utf8(piece.column("text")))
            own = [keys(s, late, light) for s in sets]
            flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.array(flat.view(np.int64)))
            n = pa.array([len(s) for s in sets], pa.int64())
            cols = [piece.column("doc_id").combine_chunks(), n, pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array([bitmap(s) for s in sets], pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _SIGNED.split(", ")])

    return docs.mapInArrow(run, _SIGNED)


def _prepared(docs: DataFrame, work: tk.Workspace, light: int | None) -> tuple[DataFrame, DataFrame, Linker]:
    """Rows signed, their classes, and what links these."""
    counts = work.save(docs.select("text").mapInArrow(_counts, _COUNTS), "counts")
    few = counts.filter("gram IS NULL").agg(F.sum("n"), F.sum("square"), F.count("*")).first()
    common = counts.filter("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(COMMON)
    common = np.sort(np.array([r.gram for r in common.select("gram").collect()], np.int64).view(np.uint64))  # COMMON rows at most
    light = boundary(few[0] or 0, few[1] or 0, few[2]) if light is None else light
    signed = work.save(_signed(docs, light, common), "signed")
    found = work.save(classes(signed), "classes")
    return signed, found, Linker(docs, found, SHINGLE, PERCENT, may, work)


def join_components(docs: DataFrame, light: int | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Rows that share an id count as one document. Texts without words (null and
    empty ones too), and null ids, link with nothing; a null id is its own
    component (null). An empty table gives no rows; other columns of docs are
    left out. ``light``: the greatest slack of a light set, if not by cost.
    """
    docs = docs.select("doc_id", "text")
    with tk.Workspace(docs.sparkSession, "jaccard-join") as work:
        signed, found, linker = _prepared(docs, work, light)
        return work.keep(labelled(signed, found, linker.components(), work))


def similar_pairs(docs: DataFrame, light: int | None = None) -> DataFrame:
    """Every link (a, b), a < b, between documents of unequal sets, each set under its least doc_id: as many rows as links."""
    docs = docs.select("doc_id", "text")
    with tk.Workspace(docs.sparkSession, "jaccard-join") as work:
        return work.keep(_prepared(docs, work, light)[2].pairs())


def op12_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """``join_components`` of all documents."""
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def links_sql(width: int, also: str = "") -> str:
    """Components of documents linked on shingles of ``width`` words, with a further column that may name ``component_id``."""
    return rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), {width}) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
f AS (
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, (SELECT min(b) FROM r WHERE a = d.doc_id)) AS component_id
  FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id)
SELECT doc_id, n_shingles, component_id{also} FROM f
"""


OP12_SQL = links_sql(SHINGLE)
