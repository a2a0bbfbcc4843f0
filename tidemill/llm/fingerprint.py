"""Merkle fingerprints of documents (operator 1).

A document is a tree: root, sections, paragraphs. Every inner hash covers the
hashes below it, so equal roots mean equal texts and unequal branches lead to
the paragraphs that an edit touched. Under each paragraph stand short marks of
its pieces (runs of up to 40 bytes that start afresh after each sentence).
Likeness is found on that walk: all marks below equal branches are common, and
only those of paragraphs that differ are compared one by one.

As text: root ; section , paragraph . marks , paragraph . marks ; section ...
with 32, 16, 16 and 8 hex digits for each hash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import textkit as tk

_PIECE = re.compile(rb"[^.!?]{1,40}[.!?]*|[.!?]+")
#: A section ends after a paragraph whose hash is 0 modulo this, and before a blank line.
SECTION_MOD = 8


def tree(text: str | None) -> tuple[str, list[tuple[str, list[tuple[str, list[int]]]]]]:
    """(root, [(section, [(paragraph, marks)])]); null is empty."""
    sections, current = [], []

    def close():
        if current:
            sections.append((blake2b("".join(p for p, _ in current).encode(), digest_size=8).hexdigest(), current.copy()))
            current.clear()

    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        if not line.strip():
            close()
        digest = blake2b(line, digest_size=8)
        current.append((digest.hexdigest(), list(map(zlib.crc32, _PIECE.findall(line)))))
        if digest.digest()[0] % SECTION_MOD == 0:
            close()
    close()
    root = blake2b("".join(s for s, _ in sections).encode(), digest_size=16).hexdigest()
    return root, sections


def encode(root: str, sections: list) -> str:
    hexed = lambda own: np.array(own, ">u4").tobytes().hex()
    return ";".join([root, *(",".join([s, *(f"{p}.{hexed(own)}" for p, own in ps)]) for s, ps in sections)])


def decode(fingerprint: str) -> tuple[str, list[tuple[str, list[tuple[str, list[int]]]]]]:
    root, *rest = fingerprint.split(";")
    sections = []
    for s in rest:
        name, *ps = s.split(",")
        pairs = (p.split(".") for p in ps)
        sections.append((name, [(p, np.frombuffer(bytes.fromhex(m), ">u4").tolist()) for p, m in pairs]))
    return root, sections


def _apart(own: list, other: list) -> tuple[int, list[tuple[int, str, list[int]]]]:
    """Marks below the branches of ``own`` that ``other`` has too, each as often; and the paragraphs (number, hash, marks) of its other branches."""
    left = Counter(s for s, _ in other)
    common, at, lone = 0, 0, []
    for s, ps in own:
        if left[s] > 0:  # an equal branch is not entered
            left[s] -= 1
            common += sum(len(marks) for _, marks in ps)
        else:
            lone += [(at + k, p, marks) for k, (p, marks) in enumerate(ps)]
        at += len(ps)
    return common, lone


def walk(a: list, b: list) -> tuple[float, list[int], list[int]]:
    """Go down the unequal branches of two trees: the share of marks in common (Dice, 0 to 1), and the numbers of the paragraphs that only a or only b has."""
    common, la = _apart(a, b)
    _, lb = _apart(b, a)
    left, right = Counter(p for _, p, _ in la), Counter(p for _, p, _ in lb)
    both = left & right
    edited: list[list] = []
    for lone in (la, lb):
        spare, rest = both.copy(), []
        for n, p, marks in lone:
            if spare[p] > 0:
                spare[p] -= 1
                common += len(marks) if lone is la else 0
            else:
                rest.append((n, marks))
        edited.append(rest)
    mine, theirs = (Counter(m for _, marks in rest for m in marks) for rest in edited)
    common += sum((mine & theirs).values())
    total = sum(len(marks) for tree_ in (a, b) for _, ps in tree_ for _, marks in ps)
    return (2 * common / total if total else 0.0), [n for n, _ in edited[0]], [n for n, _ in edited[1]]


def compare(ra: str, a: list, rb: str, b: list) -> tuple[float, list[int]]:
    """Likeness of two trees (1 for equal roots, else below), and the paragraphs of a that b lacks."""
    if ra == rb:
        return 1.0, []
    alike, own, _ = walk(a, b)
    return min(alike, 1 - 1e-9), own


def likeness(a: str, b: str) -> float:
    """1 for equal roots, else the share of marks in common below 1."""
    (ra, sa), (rb, sb) = decode(a), decode(b)
    return compare(ra, sa, rb, sb)[0]


def differences(a: str, b: str) -> tuple[list[int], list[int]]:
    """Numbers (from 0) of the paragraphs of a and of b that the other lacks; equal branches aren't entered."""
    (ra, sa), (rb, sb) = decode(a), decode(b)
    return ([], []) if ra == rb else walk(sa, sb)[1:]


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``fingerprint`` to every row, in place of a column of that name; a null text has that of an empty one, equal texts equal ones."""
    keep = [c for c in docs.columns if c != "fingerprint"]

    def run(batches):
        for piece in tk.slices(batches, text=text):
            found = [encode(*tree(t)) for t in piece.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(piece.column(c).combine_chunks() for c in keep), pa.array(found, pa.string())], names=[*keep, "fingerprint"])

    return docs.select(keep).mapInArrow(run, tk.extended(docs.select(keep), "fingerprint string"))


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """Deal (doc_id, text) into ranges of doc_id and give each range the first row of the next one too.

    Columns _bucket, _ahead, doc_id, text, sorted within partitions: every row
    is followed by its successor in ascending doc_id; the last range is
    followed by the very first row. Null ids come first, dealt by a hash of the
    text; equal ids are ordered by it. Only one row a range is sent twice.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], 10000)).first()[0] if buckets > 1 else None
    cuts = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("long")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.int64), "right"))

    nowhere = F.pmod("_tie", F.lit(buckets)) - buckets
    dealt = docs.withColumn("_bucket", F.when(F.col("doc_id").isNull(), nowhere).otherwise(range_of(F.coalesce("doc_id", F.lit(0)))))
    heads = dealt.groupBy("_bucket").agg(F.min(F.struct("doc_id", "_tie")).alias("head")).orderBy("_bucket").collect()  # one row a range
    spark = docs.sparkSession
    before = [(heads[k - 1]["_bucket"], h["head"]["doc_id"], h["head"]["_tie"]) for k, h in enumerate(heads)]
    first = F.broadcast(spark.createDataFrame(before, "_bucket long, _id long, _t long"))
    ahead = docs.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_t"))).withColumn("_ahead", F.lit(True))
    columns = ["_bucket", "_ahead", "doc_id", "text", "_tie"]
    rows = dealt.withColumn("_ahead", F.lit(False)).select(columns).unionByName(ahead.select(columns))
    return rows.repartition(-(-buckets // 4), "_bucket").sortWithinPartitions("_bucket", "_ahead", "doc_id", "_tie").drop("_tie")


_PAIRED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_at array<int>"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int32())]


def _paired(batches):
    names = [c.split()[0] for c in _PAIRED.split(", ")]
    bucket = held = None
    for piece in tk.slices(batches, 1 << 22):
        out = []
        for b, ahead, doc_id, text in zip(*(piece.column(c).to_pylist() for c in ("_bucket", "_ahead", "doc_id", "text")), strict=True):
            if bucket == b and held is None:
                continue  # behind the first row ahead
            text = text or ""
            root, sections = tree(text)
            if bucket == b:
                d, t, r, s = held
                cut = len(t) // 4
                edited = t[: len(t) - cut] + text[:cut]
                er, es = (r, s) if edited == t else tree(edited)
                near, at = compare(r, s, er, es)
                out.append((d, len(t), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), encode(r, s), encode(er, es), near, compare(r, s, root, sections)[0], at))
            bucket, held = b, None if ahead else (doc_id, text, root, sections)
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for t, c in zip(_TYPES, columns, strict=True)], names=names)


def op1_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts, likenesses, and ``edited_at``: the paragraphs that the edit touched. Null is empty; no rows, no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return with_next(docs, 4 * tk.tasks(docs)).mapInArrow(_paired, _PAIRED)
