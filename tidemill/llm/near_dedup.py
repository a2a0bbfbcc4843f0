"""Near-duplicate documents by b-bit MinHash (operator 10).

Documents with one shingle set form a class, which its least doc_id
represents; all later work is on representatives. Of PERMS minima, the first
are grouped by ROWS into the bands that propose candidates, and BITS low bits
of each are packed into a signature: equal cells, counted bitwise and corrected for
chance collisions, estimate the similarity. Estimates only rule pairs out far
below the threshold; every link is confirmed on the full shingle sets.

Links are confirmed and joined in ``linking``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import textkit as tk
from tidemill.llm.linking import Linker, Shingles, classes, labelled

#: Words of a shingle; a link is 100 * intersection >= PERCENT * union.
SHINGLE, PERCENT = 5, 85
#: Bands of ROWS minima: a pair at 0.85 is missed with probability (1 - 0.85**6)**30 = 7e-7.
ROWS, BANDS = 6, 30
PERMS = 512
#: Bits kept of a minimum, cells of a 64-bit word, words of a signature.
BITS = 4
CELLS = 64 // BITS
WORDS = -(-PERMS // CELLS)
#: Estimates below this are ruled out: 4.5 standard errors (0.0164) under 0.85.
CUT = PERCENT / 100 - 0.074

_rng = np.random.default_rng(10)
_A = (_rng.integers(0, 1 << 32, PERMS, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, PERMS, dtype=np.uint32)[:, None]


def minima(grams: np.ndarray) -> np.ndarray:
    """PERMS minima of the permuted hashes of one set."""
    h = (grams >> np.uint64(32)).astype(np.uint32)
    least = (h[None, :256] * _A + _B).min(1)
    for at in range(256, len(h), 256):
        least = np.minimum(least, (h[None, at : at + 256] * _A + _B).min(1))
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """Signatures (n, WORDS) from minima (n, PERMS)."""
    cells = np.zeros((len(least), WORDS * CELLS), np.uint64)
    cells[:, :PERMS] = (least >> np.uint32(8)) & np.uint32((1 << BITS) - 1)
    shifts = (np.arange(CELLS) * BITS).astype(np.uint64)
    return np.bitwise_or.reduce(cells.reshape(len(least), WORDS, CELLS) << shifts, axis=2)


_ONES = np.uint64(sum(1 << k for k in range(0, 64, BITS)))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal cells, corrected for cells that agree by chance; a and b broadcast."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    unequal = np.bitwise_count(x & _ONES).sum(-1, dtype=np.int64)
    chance = 0.5**BITS
    return ((PERMS - unequal) / PERMS - chance) / (1 - chance)


_SIGNED = "doc_id long, n long, k1 long, k2 long, sig binary, keys array<long>"


def _sign(batches):
    names = [c.split()[0] for c in _SIGNED.split(", ")]
    lead = tk.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    shingles = Shingles(SHINGLE)
    for piece in tk.slices(batches):
        sets, keys = shingles.sets(*tk.utf8(piece.column("text")))
        least = np.array([minima(s) if len(s) else np.zeros(PERMS, np.uint32) for s in sets], np.uint32).reshape(-1, PERMS)
        sig = packed(least)
        band = np.broadcast_to(lead, (len(sets), BANDS))
        for r in range(ROWS):
            band = tk.mix(band ^ least[:, r : ROWS * BANDS : ROWS].astype(np.uint64))
        n = np.array([len(s) for s in sets], np.int64)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(band.ravel().view(np.int64)))
        cols = [piece.column("doc_id").combine_chunks(), pa.array(n), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([s.tobytes() for s in sig], pa.binary()), flat]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def _may(n_a, sig_a, n_b, sig_b) -> np.ndarray:
    """Of pairs with sizes and signatures, those that may link."""
    ok = 100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b)
    ok[ok] = estimate(sig_a[ok], sig_b[ok]) >= CUT
    return ok


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Rows that share an id count as one document. Texts without words (null and
    empty ones too), and null ids, link with nothing; a null id is its own
    component (null) and kept. An empty table gives no rows; other columns of
    docs are left out.
    """
    with tk.Workspace(docs.sparkSession, "near-dedup") as work:
        return work.keep(_near_duplicates(docs.select("doc_id", "text"), work))


def _near_duplicates(docs: DataFrame, work: tk.Workspace) -> DataFrame:
    signed = work.save(docs.mapInArrow(_sign, _SIGNED), "signed")
    found = work.save(classes(signed), "classes")
    linked = Linker(docs, found, SHINGLE, PERCENT, _may, work).components()
    out = labelled(signed, found, linked, work)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    """``near_duplicates`` of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that represent their group, with all their columns; of rows with one id, those stay or go together."""
    own, back = tk.aside(docs, "doc_id", "text")
    kept = near_duplicates(own).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return own.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi").select(back)
