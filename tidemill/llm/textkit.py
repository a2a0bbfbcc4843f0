"""Vectorised text kernels and the shared work folder of the training-data operators.

Arrow hands a task the UTF-8 bytes of many texts in one buffer; the kernels
here find words, hash them and select anchors over such a buffer without a
Python loop over rows.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Multipliers of the polynomial hashes (odd 64-bit constants of splitmix64).
_MUL = 0x9E3779B97F4A7C15
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)

SLICE_BYTES = 1 << 20

#: Bytes of words: everything but blanks.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words: ASCII letters, digits, and all of every other script.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def shared_folder(spark) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only if all run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="tidemill-")


class Workspace:
    """Tables of one call, in the shared folder. As a context manager it drops them all at the end, but for those of ``keep``."""

    def __init__(self, spark, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.drop("")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df):
        """Write a result beside the work tables and read it back; it is the caller's from then on."""
        path = f"{self.root}-result"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save(self, df, name: str, by: str | None = None):
        """Write df, in folders by a column if given, and read it back: cuts the lineage, survives a lost executor."""
        out = df.write.mode("overwrite").option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        remove(self.spark, self.path(name).rstrip("/"))


def remove(spark, path: str) -> None:
    """Delete a folder of any store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark) -> None:
    """Let Spark remove the shuffle files of finished steps, which it does when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def parts(spark) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks(df, size: int = 64 << 20) -> int:
    """Tasks to deal df to: the session's number, or more if its sources' files (as far as the plan knows) have over ``size`` bytes for each."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(parts(df.sparkSession), known // size) if known < 1 << 60 else parts(df.sparkSession)


def aside(docs, *needed: str):
    """docs with all columns but the needed ones renamed out of the way, and the columns that give the old names back."""
    names = [c if c in needed else f"_own{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def extended(df, more: str) -> StructType:
    """The schema of df with further columns, given as DDL."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system: workers live on between stages, and an executor's share is bounded."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc := ctypes.CDLL(None), "malloc_trim"):
        _libc.malloc_trim(0)


def slices(batches, size: int = SLICE_BYTES, text: str = "text"):
    """Cut record batches so that each piece holds about ``size`` bytes of text (a longer text comes alone)."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield table.slice(at, to - at).combine_chunks()
            at = to
    batch = table = None
    give_back()


_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _MUL) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


_INV = inverse(_MUL)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def prefix(values: np.ndarray, base: int = _MUL) -> np.ndarray:
    """Prefix sums of values[i] * base**i with a leading zero, for ``ranges``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), base), out=out[1:])
    return out


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _MUL) -> np.ndarray:
    """64-bit hashes of the ranges [start, end) of what ``prefix`` summed with that base."""
    return mix((sums[end] - sums[start]) * powers(len(sums), inverse(base))[start] + (end - start).astype(np.uint64))


def words(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and n+1 offsets of rows among the words."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = is_word[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    a, b = offsets[:-1][full], offsets[1:][full] - 1
    first[a] = inside[a]
    last[b] = inside[b]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return ranges(prefix(buf.astype(np.uint64) + np.uint64(1)), start, end)


def word_array(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.LargeBinaryArray:
    """The words [start, end) of buf, ascending and apart, as one Arrow column."""
    size = end - start
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[start] = 1
    np.subtract.at(inside, end, 1)  # where a word begins as another ends the two cancel out, and the run goes on
    data = buf[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_LANES = np.array([[0x2545F4914F6CDD1D], [0x9FB21C651E98DF25]], np.uint64)


def word_codes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit codes of words, as two rows of 64 bits: eight bytes at a time are mixed in, so no text has the regular collisions of a polynomial."""
    size = end - start
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray(len(buf) + 1, np.uint64, padded, strides=(1,))  # the eight bytes from each place on
    out = mix(_LANES ^ size.astype(np.uint64))
    on = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while len(on):
        left = np.minimum(size[on] - at, 8).astype(np.uint64)
        block = eight[start[on] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        out[:, on] = mix((out[:, on] ^ block) + _LANES)
        at += 8
        on = on[size[on] > at]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[:, k] = np.frombuffer(blake2b(buf[start[k] : end[k]].tobytes(), digest_size=16, key=b"tidemill").digest(), np.uint64)
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i : i + width] for each i that has a whole window."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def anchored(hashes: np.ndarray, rows: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deal the windows of ``window`` units to anchors.

    hashes[i] is the hash of the gram of ``gram`` units at unit i (of rows[r]..rows[r+1]).
    The anchor of a window is the leftmost gram of least hash in it, so equal
    windows have equal anchors at equal places. Returns, for each run of
    windows of a row with one anchor: the first and last window start, and
    the anchor's unit.
    """
    none = np.zeros(0, np.int64)
    n = int(rows[-1])
    if n < window:
        return none, none, none
    bits = np.uint64(max(1, n.bit_length()))
    keyed = ((hashes[:n] >> bits) << bits) | np.arange(n, dtype=np.uint64)
    least = sliding_min(keyed[: n - gram + 1], window - gram + 1)
    at = (least & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    valid = np.flatnonzero(row[: len(at)] == row[window - 1 : window - 1 + len(at)])
    if not len(valid):
        return none, none, none
    at, row = at[valid], row[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], len(valid)) - 1
    return valid[begin], valid[stop], at[begin]


def segment_sum(values: np.ndarray, rows: np.ndarray, dtype=np.float64) -> np.ndarray:
    """Sums of values[rows[r] : rows[r+1]]; 0 where empty."""
    sums = np.zeros((len(values) + 1, *values.shape[1:]), dtype)
    np.cumsum(values, axis=0, dtype=dtype, out=sums[1:])
    return sums[rows[1:]] - sums[rows[:-1]]
