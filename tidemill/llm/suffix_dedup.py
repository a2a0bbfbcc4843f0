"""Repeated substrings by an enhanced suffix array with a common-prefix interval tree (operator 4).

Segments (the windows of a shared anchor, with their surroundings) meet in
the anchor's bucket, equal contents once or, if several documents hold them,
twice. There all suffixes that begin a window are sorted by their bytes, with
the lengths of their common prefixes; a scan with a stack walks the intervals
of the array, and those whose occurrences differ in the byte before them are
maximal repeats, given with all occurrences. A repeat that runs on over several
anchors appears as one group for each of their segments. Windows of a very
frequent anchor are dealt by their first LEAST bytes instead, each with the
rest of its segment, and go through the same array and tree.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm import textkit as tk
from tidemill.llm.repeats import COVERS, HOT, SEGMENTS, Chunks, Cut, Kind, Marks, Segments, covers, extremes, grouped, pieces, send, shared_anchors, spread, with_hot

#: Bytes of a repeat at least, and of an anchor's gram.
LEAST, GRAM = 50, 16


def _bytes(buf: np.ndarray, offsets: np.ndarray) -> Cut:
    sums = tk.prefix(buf.astype(np.uint64) + np.uint64(1))
    n = len(buf)
    grams = np.zeros(n, np.uint64)
    if n >= GRAM:
        inverse = tk.powers(n + 1, tk._INV)
        grams[: n - GRAM + 1] = tk.mix((sums[GRAM:] - sums[: n - GRAM + 1]) * inverse[: n - GRAM + 1])
    return Cut(grams, offsets, buf)


KIND = Kind(_bytes, LEAST, GRAM, tail=True)


def _leading(x: np.ndarray) -> np.ndarray:
    """Zero bytes before the first other one of 64-bit numbers that are not 0."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(k))
    return (64 - np.bitwise_count(x).astype(np.int64)) >> 3


def suffix_array(buf: np.ndarray, begin: np.ndarray, size: np.ndarray, suffixes: np.ndarray, least: int, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts, of the first ``suffixes`` suffixes of each of the segments buf[begin : begin + size] those that another one may equal in ``least`` bytes.

    Returns each one's segment, its offset and the common prefix with the one
    before. A hash of the first bytes rules out suffixes that stand alone and
    brings the others together; should it bring different ones together, all
    bytes are sorted. ``sums``: of ``tk.prefix`` over the bytes + 1.
    """
    off, seg = spread(np.zeros_like(size), suffixes - 1)
    at = begin[seg] + off
    head = tk.ranges(tk.prefix(buf.astype(np.uint64) + np.uint64(1)) if sums is None else sums, at, at + least)
    by = np.argsort(head)
    head = head[by]
    fresh = np.append(True, head[1:] != head[:-1])
    group = np.cumsum(fresh)
    company = np.bincount(group)[group] > 1
    by, group = by[company], group[company]
    seg, off = seg[by], off[by]
    width = int(size.max())
    words = -(-width // 8)
    padded = np.zeros((len(begin), words * 8 + 8), np.uint8)
    at, of = spread(begin, begin + size - 1)
    padded[of, at - begin[of]] = buf[at]
    wide = np.zeros((len(begin), words * 8 + 1), np.uint64)
    for j in range(8):
        wide |= padded[:, j : j + words * 8 + 1].astype(np.uint64) << np.uint64(56 - 8 * j)
    keys = [wide[seg, np.minimum(off + 8 * j, words * 8)] for j in range(words)]

    def common(order: np.ndarray, same: np.ndarray) -> np.ndarray:
        """Of the neighbours in order that ``same`` names: the common prefix; 0 for others and the first."""
        lcp = np.zeros(len(order), np.int64)
        pair = np.flatnonzero(same) + 1
        for j, key in enumerate(keys):
            x = key[order[pair]] ^ key[order[pair - 1]]
            differ = x != 0
            lcp[pair[differ]] = 8 * j + _leading(x[differ])
            pair = pair[~differ]
        lcp[pair] = 8 * words
        left = (size[seg] - off)[order]
        lcp[1:] = np.minimum(lcp[1:], np.minimum(left[1:], left[:-1]))
        return lcp

    order = np.lexsort([*keys[: least // 8 - 1 if least >= 8 else None : -1], group])
    together = group[order][1:] == group[order][:-1]
    lcp = common(order, together)
    if (lcp[1:][together] < least).any():
        order = np.lexsort(keys[::-1])
        lcp = common(order, np.ones(max(0, len(order) - 1), bool))
    return seg[order], off[order], lcp


def intervals(lcp: list[int]) -> list[tuple[int, int, int]]:
    """(length, first, last) of all intervals of two suffixes or more; lcp[i] is that of i and i - 1."""
    found, stack = [], []
    for i in range(1, len(lcp) + 1):
        n = lcp[i] if i < len(lcp) else 0
        first = i - 1
        while stack and stack[-1][0] > n:
            length, first = stack.pop()
            found.append((length, first, i - 1))
        if n and (not stack or stack[-1][0] < n):
            stack.append((n, first))
    return found


def maximal_repeats(buf: np.ndarray, begin: np.ndarray, size: np.ndarray, least: int = LEAST, suffixes: np.ndarray | None = None, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Repeats of ``least`` bytes or more between (or within) segments that can't be extended to either side.

    ``suffixes``: of each segment, the first that count (all that are long enough).

    Returns, for each occurrence: number of its group, length, segment, offset.
    An occurrence at a segment's start counts as differing on its left.
    """
    none = np.zeros(0, np.int64)
    if not len(begin):
        return none, none, none, none
    seg, off, lcp = suffix_array(buf, begin, size, size - least + 1 if suffixes is None else suffixes, least, sums)
    if not len(seg):
        return none, none, none, none
    before = np.where(off > 0, buf[np.maximum(begin[seg] + off - 1, 0)].astype(np.int64), -1)
    start = np.flatnonzero(lcp < least)  # of the intervals at depth ``least``
    count = np.diff(np.append(start, len(seg)))
    low, high = np.minimum.reduceat(before, start), np.maximum.reduceat(before, start)
    inner = lcp.copy()
    inner[start] = 1 << 30
    shallow = np.minimum.reduceat(inner, start)
    inner[start] = 0
    deep = np.maximum.reduceat(inner, start)
    diverse = (count > 1) & ((low != high) | (low < 0))
    group, length, member = [], [], []
    plain = np.flatnonzero(diverse & (shallow == deep))
    at, of = spread(start[plain], start[plain] + count[plain] - 1)
    group.append(of)
    length.append(shallow[plain][of])
    member.append(at)
    n = len(plain)
    for c in np.flatnonzero(diverse & (shallow != deep)):
        a, b = int(start[c]), int(start[c] + count[c])
        own = before[a:b]
        for size_, i, j in intervals([0, *lcp[a + 1 : b].tolist()]):
            chars = own[i : j + 1]
            if chars.min() < 0 or (chars != chars[0]).any():
                group.append(np.full(j - i + 1, n))
                length.append(np.full(j - i + 1, size_))
                member.append(np.arange(a + i, a + j + 1))
                n += 1
    member = np.concatenate(member)
    return np.concatenate(group), np.concatenate(length), seg[member], off[member]


#: Suffixes that are sorted at once, about.
SORTED = 1 << 17


def _cover(table: pa.Table) -> pa.Table:
    """In an anchor's bucket: stretches of contents that repeat, with the least document that holds them, back to the chunks.

    A content that several documents hold enters the suffix array twice, for
    the least of them and for another, so that the tree finds it whole too.
    """
    got = Segments(table)
    own, shift = np.arange(len(got.one)), np.flatnonzero(got.least != got.most)
    member = np.concatenate([own, shift])  # the second copies behind the first
    place = got.one[member]
    key, first = grouped(got.key[place])
    count = np.diff(np.append(first, len(key)))
    met = key[np.repeat(count > 1, count)]  # those whose anchor has company, anchor by anchor
    suffixes = np.where(got.lone[place], 1, got.size[place] - LEAST + 1)[met]
    edges = np.append(True, got.key[place[met]][1:] != got.key[place[met]][:-1]) if len(met) else np.zeros(0, bool)
    part = (np.cumsum(suffixes) - suffixes) // SORTED
    part = part[np.flatnonzero(edges)][np.cumsum(edges) - 1] if len(met) else part  # an anchor is not parted
    sums = tk.prefix(got.buf.astype(np.uint64) + np.uint64(1))
    found = [[np.zeros(0, np.int64)] * 4]
    for a, b in zip(*_bounds(part), strict=True):
        one = met[a:b]
        group, length, seg, off = maximal_repeats(got.buf, got.begin[place[one]], got.size[place[one]], LEAST, suffixes[a:b], sums)
        if not len(group):
            continue
        smallest, _ = extremes(group, got.least[member[one[seg]]], got.least[member[one[seg]]])
        ok = one[seg] < len(own)
        found.append([member[one[seg[ok]]], off[ok], off[ok] + length[ok], smallest[group[ok]]])
    return covers(got, *map(np.concatenate, zip(*found, strict=True)))


def _bounds(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    return start, np.append(start[1:], len(part)) if len(part) else start


_REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remove(with_text: bool):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        marks, rows = Marks(answers), []
        for piece, ids, buf, offsets in pieces(table):
            gone = marks.gone(KIND, _bytes(buf, offsets), ids)
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            heads = offsets[:-1][offsets[:-1] < offsets[1:]]
            opens[heads] = gone[heads]
            n_removed, n_spans = tk.segment_sum(gone, offsets, np.int64), tk.segment_sum(opens, offsets, np.int64)
            kept = [buf[a:b].tobytes() if not k else buf[a:b][~gone[a:b]].tobytes() for a, b, k in zip(offsets[:-1], offsets[1:], n_removed, strict=True)]
            out = {"doc_id": piece.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(n_removed), "n_spans": pa.array(n_spans), "kept_sha256": pa.array([sha256(k).hexdigest() for k in kept], pa.string())}
            if with_text:
                out["kept"] = pa.array(kept, pa.binary())
            rows.append(pa.table(out))
        return pa.concat_tables(rows)

    return run


def drop_repeats(docs: DataFrame, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """Per row of docs (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256, and kept (bytes) if with_text.

    Bytes covered by a string of LEAST bytes that also starts in a document of
    smaller doc_id go. Null texts are empty; rows of one id are no smaller
    than one another; null ids count as larger than all. An empty table gives
    no rows; other columns of docs are left out. ``hot``: see ``repeats``.
    """
    with tk.Workspace(docs.sparkSession, "suffix-dedup") as work:
        chunks = Chunks(docs, work.path("texts"))
        try:
            shared = shared_anchors(chunks, KIND, work, hot)
            sent = chunks.answer(shared, send(KIND, chunks.n), SEGMENTS)
            answers = work.save(with_hot(sent.groupBy("bucket").applyInArrow(_cover, COVERS), shared), "covers")
            del sent
            tk.release(docs.sparkSession)
            return work.keep(chunks.answer(answers, _remove(with_text), _REMOVED + (", kept binary" if with_text else "")))
        finally:
            chunks.forget()


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """``drop_repeats`` of all documents."""
    return drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
